"""Counting ordered funnels by a monotone merge of time-sorted streams.

A funnel is a list of kinds, and kinds that end an attempt. Every row of the first kind starts an attempt;
the next step is the earliest row of its kind, of the same client and later than the step before, unless
the time runs out or an excluded row comes first (at the step's own time included).

Distinct rows are dealt by ranges of (client, time) and sorted within them, so a client with most rows is
spread over many tasks, and a task takes its rows in stretches of bounded length. Within a stretch the
starts ascend, so each step's pointer into its kind's stream only advances: the pointers of all rows are
the running minimum, from the last row back, of the positions of that kind. An attempt that has reached
the end of its stretch stays open there; it goes on in the head of the stretches that follow. A head has
the rows that an attempt coming from before can meet: the first of each kind, and the chain of steps and
exclusions that follows from it. That is a number of rows set by the funnels alone.

Counts leave a stretch summed by client; times are summed by value, dealt by range, sorted by Spark
(which spills) and ranked with the counts of the ranges before, so that none needs a group in memory.

Edge cases: rows with a null client, kind or time are no rows; repeated rows count once; rows of several
kinds at one time are not later than each other; kinds that no funnel names are ignored; an empty table
gives no row. Only the three columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import kept, lean, parts_for


class Funnel(NamedTuple):
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...]


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)
#: Microseconds from one step to the next, at most.
WITHIN = 15 * 60 * 1_000_000
#: Rows in a stretch, and rows of the table to a range.
STRETCH = RANGE = 1 << 19
#: What a row of a stretch's result is.
COUNT, TIME, OPEN, HEAD, END = range(5)
RESULT = "what byte, stretch long, client_id long, funnel byte, step byte, at long, n long"
FIELDS = [x.split()[0] for x in RESULT.split(", ")]


class Machine:
    """The funnels with their kinds as numbers."""

    def __init__(self, funnels: Sequence[Funnel] = FUNNELS, within: int = WITHIN) -> None:
        self.kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
        number = {k: i for i, k in enumerate(self.kinds)}
        self.steps = [[number[k] for k in f.steps] for f in funnels]
        self.excluded = [[number[k] for k in f.excluded] for f in funnels]
        self.within = within

    def advance(self, funnel: int, step: int, slot: np.ndarray, time: np.ndarray, following: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From slots at ``step`` to those of the next: the slot, or -1 where the attempt ends, or -2 where it reaches the end of the stretch.

        ``following[k]`` has, for each slot, the next later slot of kind k, whoever's it is; ``end`` the first slot after the client's.
        """
        to, stop = following[self.steps[funnel][step]][slot], end[slot]
        bar = np.min([following[k][slot] for k in self.excluded[funnel]], axis=0) if self.excluded[funnel] else np.full(len(slot), len(time))
        found, barred = to < stop, (bar < stop) & (bar <= to)
        late = np.zeros(len(slot), bool)
        late[found] = time[to[found]] - time[slot[found]] > self.within
        last = (stop == len(time)) & (time[-1] - time[slot] < self.within)
        return np.where(barred | late, -1, np.where(found, to, np.where(last, -2, -1))), to

    def pointers(self, client: np.ndarray, time: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots (a client's distinct times) of sorted rows: client, time, which kinds, the next slot of each kind, and the client's end."""
        first = np.r_[True, (client[1:] != client[:-1]) | (time[1:] != time[:-1])]
        slot = np.cumsum(first) - 1
        n = int(slot[-1]) + 1
        client, time = client[first], time[first]
        has = np.zeros((len(self.kinds), n), bool)
        has[kind, slot] = True
        following = np.full((len(self.kinds), n), n)
        at = np.where(has, np.arange(n), n)
        following[:, :-1] = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, 1:]
        ends = np.flatnonzero(np.r_[client[1:] != client[:-1], True]) + 1
        return client, time, has, following, np.repeat(ends, np.diff(np.r_[0, ends]))

    def stretch(self, number: int, client: np.ndarray, time: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
        """Result rows of one stretch; all rows of a client's time are in the same stretch."""
        client, time, has, following, end = self.pointers(client, time, kind)
        out = [self.rows(END, number, client[-1:], 0, 0, time[-1:], 1), self.head(number, client, time, has, following, end)]
        for f, steps in enumerate(self.steps):
            slot = np.flatnonzero(has[steps[0]])
            n = np.ones(len(slot), int)
            for s in range(len(steps)):
                self.counted(out, number, f, s, client[slot], n)
                if s + 1 == len(steps) or not len(slot):
                    break
                then, _ = self.advance(f, s + 1, slot, time, following, end)
                out.append(self.rows(OPEN, number, client[slot[then == -2]], f, s, time[slot[then == -2]], n[then == -2]))
                on = then >= 0
                out.append(self.rows(TIME, number, client[slot[on]], f, s + 1, time[then[on]] - time[slot[on]], n[on]))
                slot, n = then[on], n[on]
        return out

    def head(self, number: int, client: np.ndarray, time: np.ndarray, has: np.ndarray, following: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What attempts that come from before can meet: the first of each kind, and where they can go from there."""
        stop, n = int(end[0]), len(time)
        met: set[tuple[int, int]] = set()
        first = [0 if has[k, 0] else int(following[k, 0]) for k in range(len(self.kinds))]
        met.update((slot, k) for k, slot in enumerate(first) if slot < stop)
        for steps, excluded in zip(self.steps, self.excluded):
            for s in range(1, len(steps)):
                slot = first[steps[s]]
                for k in steps[s + 1 :] + [-1]:
                    if slot >= min(stop, n):
                        break
                    met.update((int(following[x, slot]), x) for x in excluded if following[x, slot] < stop)
                    if k >= 0:
                        slot = int(following[k, slot])
                        if slot < stop:
                            met.add((slot, k))
        slots, kinds = np.array(sorted(met)).T
        return self.rows(HEAD, number, client[slots], 0, kinds, time[slots], 1)

    @staticmethod
    def counted(out: list[np.ndarray], number: int, funnel: int, step: int, client: np.ndarray, n: np.ndarray) -> None:
        """Appends the counts, summed by client (clients ascend, though steps of different starts may meet)."""
        if len(client):
            first = np.r_[True, client[1:] != client[:-1]]
            out.append(Machine.rows(COUNT, number, client[first], funnel, step, 0, np.add.reduceat(n, np.flatnonzero(first))))

    @staticmethod
    def rows(what: int, number: int, client: np.ndarray, funnel, step, at, n) -> np.ndarray:
        out = np.empty((7, len(client)), int)
        for i, x in enumerate((what, number, client, funnel, step, at, n)):
            out[i] = x
        return out

    def resume(self, opened: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        """Counts and times of attempts that were open at the end of a stretch, in the rows ahead of it."""
        out: list[np.ndarray] = []
        ahead = ahead.drop_duplicates(["at", "step"]).sort_values("at", kind="stable")
        number, who = (int(opened[c].iloc[0]) if len(opened) else 0 for c in ("stretch", "client_id"))
        for (f, s), part in opened.groupby(["funnel", "step"]) if len(ahead) else ():
            at = part["at"].to_numpy()
            order = np.argsort(at, kind="stable")
            at, n = at[order], part["n"].to_numpy()[order]
            # the open attempts come first, as rows of a kind that no step asks for
            kinds = np.r_[np.full(len(at), len(self.kinds)), ahead["step"].to_numpy()].astype(int)
            times = np.r_[at, ahead["at"].to_numpy()]
            blind = Machine.__new__(Machine)
            blind.kinds, blind.steps, blind.excluded, blind.within = [*self.kinds, ""], self.steps, self.excluded, self.within
            clients, time, has, following, end = blind.pointers(np.full(len(times), who), times, kinds)
            slot = np.searchsorted(time, at)
            for step in range(s, len(self.steps[f]) - 1):
                then, _ = self.advance(f, step + 1, slot, time, following, end)
                on = then >= 0
                out.append(self.rows(TIME, number, clients[slot[on]], f, step + 1, time[then[on]] - time[slot[on]], n[on]))
                slot, n = then[on], n[on]
                self.counted(out, number, f, step + 1, clients[slot], n)
        return pd.DataFrame(np.concatenate(out, axis=1).T if out else np.zeros((0, 7), int), columns=FIELDS)


def merged(clicks: DataFrame, machine: Machine, parts: int, stretch: int = STRETCH) -> DataFrame:
    """Counts and times of all attempts (``RESULT``), in parts that are still to be added up."""
    kinds = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(machine.kinds)) for x in pair))
    rows = clicks.filter(F.col("kind").isin(machine.kinds)).select(F.col("client_id").cast("long").alias("client_id"), "ts", kinds[F.col("kind")].cast("byte").alias("k")).dropna().distinct()
    dealt = rows.repartitionByRange(parts, "client_id", "ts").sortWithinPartitions("client_id", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def result(rows: list[np.ndarray]) -> pa.RecordBatch:
            found = machine.stretch(number, *rows)
            types = [pa.int8(), pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(np.concatenate(found, axis=1), types)], names=FIELDS)

        for batch in batches:
            held.append([batch.column("client_id").to_numpy(), batch.column("ts").cast(pa.int64()).to_numpy(), batch.column("k").to_numpy()])
            count += batch.num_rows
            if count >= stretch:
                whole = [np.concatenate(x) for x in zip(*held)]
                client, time, _ = whole
                cut = int(np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (time[1:] != time[:-1])])[-1])  # the last time may go on
                if cut:
                    yield result([x[:cut] for x in whole])
                    number += 1
                held, count = [[x[cut:] for x in whole]], count - cut
        if count:
            yield result([np.concatenate(x) for x in zip(*held)])

    found = kept(dealt.mapInArrow(lean(run), RESULT))
    # ends look ahead as far as the steps that are left can reach; times in bins of that length make the join one by equality
    far = machine.within * (max(map(len, machine.steps)) - 1)
    binned = lambda at: F.floor(at / F.lit(far)).cast("long")
    opened = found.filter(F.col("what") == OPEN).groupBy("stretch", "client_id", "funnel", "step", "at").agg(F.sum("n").alias("n"))
    ends = found.filter(F.col("what") == END).select(F.col("stretch").alias("from"), "client_id", F.col("at").alias("last"), F.explode(F.array(binned(F.col("at")), binned(F.col("at")) + 1)).alias("bin"))
    heads = found.filter(F.col("what") == HEAD).select("client_id", "step", "at", binned(F.col("at")).alias("bin"))
    ahead = ends.join(heads, ["client_id", "bin"]).filter((F.col("at") > F.col("last")) & (F.col("at") - F.col("last") <= far)).select(F.col("from").alias("stretch"), "step", "at")
    resumed = opened.groupBy("stretch").cogroup(ahead.groupBy("stretch")).applyInPandas(lambda a, b: machine.resume(a, b), RESULT)
    return found.filter(F.col("what").isin(COUNT, TIME)).unionByName(resumed)


def ranked(times: DataFrame, keys: list[str], value: str, parts: int, percent: int = 50) -> DataFrame:
    """The ceil(percent * n / 100)-th smallest value of each group, where a row counts ``n`` times."""
    summed = times.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    dealt = kept(summed.repartitionByRange(parts, *keys, value).withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy(*keys).orderBy("part")
    pieces = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("piece"))
    pieces = pieces.withColumn("upto", F.sum("piece").over(order)).withColumn("total", F.sum("piece").over(Window.partitionBy(*keys)))
    rank = F.expr(f"({percent} * total + 99) div 100")
    asked = pieces.withColumn("rank", rank).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("piece"))).select(*keys, "part", (F.col("rank") - F.col("upto") + F.col("piece")).alias("rank"))
    within = Window.partitionBy(*keys, "part").orderBy(value)
    counted = dealt.join(asked, [*keys, "part"]).withColumn("upto", F.sum("n").over(within))
    return counted.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(*keys, value)


def funnels(clicks: DataFrame, defined: Sequence[Funnel] = FUNNELS, within: int = WITHIN, stretch: int = STRETCH) -> DataFrame:
    """A row for each funnel and client with attempts: how many reached each step, and the median time of each step."""
    ship(clicks.sparkSession)
    machine = Machine(defined, within)
    keys, depth = ["funnel", "client_id"], max(len(f.steps) for f in defined)
    parts = parts_for(clicks.sparkSession, clicks.count(), RANGE)
    found = kept(merged(clicks, machine, parts, stretch).groupBy("what", *keys, "step", "at").agg(F.sum("n").alias("n")))
    medians = ranked(found.filter(F.col("what") == TIME).select(*keys, "step", "at", "n"), [*keys, "step"], "at", parts).select(*keys, "step", F.lit(0).cast("long").alias("n"), "at")
    both = found.filter(F.col("what") == COUNT).select(*keys, "step", "n", F.lit(None).cast("long").alias("at")).unionByName(medians)
    at = lambda s: F.col("step") == s
    rows = both.groupBy(*keys).agg(
        *(F.sum(F.when(at(s), F.col("n")).otherwise(0)).alias(f"n{s + 1}") for s in range(depth)),
        F.max(F.when(F.col("n") > 0, F.col("step") + 1)).cast("int").alias("deepest"),
        *(F.max(F.when(at(s), F.col("at"))).alias(f"t{s + 1}") for s in range(1, depth)),
    )
    rows = kept(rows)
    same = rows.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # as many rows as the funnels have steps
    name = F.element_at(F.array(*(F.lit(f.name) for f in defined)), F.col("funnel").cast("int") + 1)
    return rows.join(F.broadcast(same), ["funnel", "deepest"]).select(name.alias("funnel"), "client_id", *(f"n{s + 1}" for s in range(depth)), "deepest", *(f"t{s + 1}" for s in range(1, depth)), "same_depth")


def op13_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def funnel_sql() -> str:
    """DuckDB's: each step by an as-of join to the next row of its kind and to the next excluded row."""
    parts = ["WITH rows AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL)"]
    for f in FUNNELS:
        parts.append(f"{f.name}1 AS (SELECT client_id, ts AS at, CAST(NULL AS BIGINT) AS t FROM rows WHERE kind = '{f.steps[0]}')")
        for s, kind in enumerate(f.steps[1:], 2):
            parts.append(
                f"{f.name}{s} AS (SELECT a.client_id, b.ts AS at, date_diff('microsecond', a.at, b.ts) AS t FROM {f.name}{s - 1} a"
                f" ASOF JOIN (SELECT client_id, ts FROM rows WHERE kind = '{kind}') b ON a.client_id = b.client_id AND a.at < b.ts"
                f" ASOF LEFT JOIN (SELECT client_id, ts FROM rows WHERE kind = '{f.excluded[0]}') x ON a.client_id = x.client_id AND a.at < x.ts"
                " WHERE b.ts - a.at <= INTERVAL 15 MINUTE AND (x.ts IS NULL OR x.ts > b.ts))"
            )
    each = " UNION ALL ".join(f"SELECT '{f.name}' AS funnel, {s} AS step, client_id, t FROM {f.name}{s}" for f in FUNNELS for s in range(1, 5))
    parts.append(f"reached AS ({each})")
    parts.append("placed AS (SELECT *, row_number() OVER (PARTITION BY funnel, step, client_id ORDER BY t) AS place, count(*) OVER (PARTITION BY funnel, step, client_id) AS n FROM reached)")
    counts = ", ".join(f"count(*) FILTER (step = {s}) AS n{s}" for s in range(1, 5))
    times = ", ".join(f"max(t) FILTER (step = {s} AND place = (n + 1) // 2) AS t{s}" for s in range(2, 5))
    parts.append(f"summed AS (SELECT funnel, client_id, {counts}, CAST(max(step) AS INTEGER) AS deepest, {times} FROM placed GROUP BY funnel, client_id)")
    return ", ".join(parts) + " SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM summed"


OP13_SQL = funnel_sql()
