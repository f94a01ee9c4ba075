"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is its weighted share of the mix, but no more than ``limit`` times its words. A
document is taken ``floor(target / size of source)`` times, and once more with the fraction that is left
as its inclusion probability. The flight phase moves the probabilities of three undecided documents at a
time along the null space of the constraints (number of documents, number of words) until at least one
reaches 0 or 1; a chunk of a source ends with at most two undecided documents. What chunks leave
undecided flies again, source by source, and the two that a source may leave in the end are rounded to
the nearest total of words (the landing). Longest documents fly first, so that the landing is small.

Edge cases: a null or empty text has size 0; the null source is a source of its own, ordered last; rows
that agree in doc_id, source and size share one decision and are each reported; a null doc_id keeps its
row; an empty table gives no rows. Draws depend on the data alone, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, documents, kept, numbered

#: Documents to a chunk of a source in the flight phase.
CHUNK = 4096


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``sources`` (source, source_size, units) with ``target``: words by weight, at most ``limit`` times the size, the excess reshared.

    A source stops where its weight at the common level reaches its limit; the level rises until what is
    left and the weights that share it agree. Sources stay a table, however many there are.
    """
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weighted = kept(ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    size, weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = share * (size or 0), 0.0
    rises = total / weight if weight else 0.0
    while rises > level:
        level = rises
        stopped = limit * F.col("source_size") < F.col("weight") * level
        full, rest = weighted.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size"))), F.lit(0)), F.sum(F.when(~stopped, F.col("weight")))).first()
        rises = (total - limit * full) / rest if rest else level
    return weighted.select("source", "source_size", "units", F.least(limit * F.col("source_size"), F.col("weight") * level).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` to 0 or 1, all but two at most, keeping sum(p) and sum(p * size)."""
    out = p.astype(float).copy()
    s = size.astype(float)
    undecided = np.flatnonzero((out > 0) & (out < 1)).tolist()
    window, after = undecided[:3], 3
    draws = iter(rng.random(len(out) + 3))
    while len(window) == 3:
        i, j, k = window
        u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - out[a]) / d if d > 0 else out[a] / -d for a, d in zip(window, u) if d)
        down = min(out[a] / d if d > 0 else (1 - out[a]) / -d for a, d in zip(window, u) if d)
        step = up if next(draws) * (up + down) < down else -down
        for a, d in zip(window, u):
            v = out[a] + step * d
            out[a] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        window = [a for a in window if 0 < out[a] < 1]
        more = 3 - len(window)
        window += undecided[after : after + more]
        after += more
    return out


def landing(size: np.ndarray, p: np.ndarray, expected: float) -> np.ndarray:
    """Rounds the undecided, two at most, to the total of words that is nearest to the expected one.

    Then at most one document that is taken and one that is not change places, where that comes nearer:
    the number of documents stays.
    """
    out = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    out[left] = 0
    missing = expected - float(np.dot(size, out))
    out[left] = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(float(np.dot(size[left], x)) - missing), x))
    over = float(np.dot(size, out)) - expected
    taken, free = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    if len(taken) and len(free) and over:
        free = free[np.argsort(size[free], kind="stable")]
        at = np.searchsorted(size[free], size[taken] - over)
        pairs = [(abs(over - size[t] + size[free[k]]), int(t), int(free[k])) for off in (-1, 0) for t, k in zip(taken, np.clip(at + off, 0, len(free) - 1))]
        best, i, j = min(pairs)
        if best < abs(over):
            out[i], out[j] = 0, 1
    return out


def flown(units: DataFrame, last: bool) -> DataFrame:
    """``units`` with p moved, by source and chunk; ``chunks`` says how many chunks a source has."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bulk", "lot"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        source = group["source"].iloc[0]
        rng = np.random.default_rng(zlib.crc32(f"{source}|{group['chunk'].iloc[0]}|{last}".encode()))
        size, before = group["bulk"].to_numpy(), group["p"].to_numpy()
        p = flight(size, before, rng)
        group["p"] = landing(size, p, float(np.dot(size, before))) if last else p
        return group.drop(columns="chunk")

    chunked = units.withColumn("chunk", F.pmod("lot", "chunks"))
    return chunked.groupBy("source", "chunk").applyInPandas(run, units.schema)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, a row for each row of ``docs``."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    units = kept(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    goal = kept(targets(sources, weights, share, limit).withColumn("chunks", F.ceil(F.col("units") / chunk)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = units.join(goal.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    drawn = drawn.select("doc_id", "source", "size", "n", "source_size", "target", "chunks", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"), (F.col("size") * F.col("n")).alias("bulk"), F.xxhash64("doc_id", "source", "size").alias("lot"))
    chunks = goal.agg(F.max("chunks")).first()[0] or 1
    decided = []
    while chunks > 1:
        drawn = kept(flown(drawn, False))
        decided.append(drawn.filter("p <= 0 or p >= 1"))
        drawn = drawn.filter("p > 0 and p < 1").withColumn("chunks", F.ceil(F.col("chunks") * 2 / chunk))
        chunks = math.ceil(chunks * 2 / chunk)
    done = flown(drawn.withColumn("chunks", F.lit(1).cast("long")), True)
    for part in decided:
        done = done.unionByName(part)
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "n").select("*", (F.col("copies") * F.col("size")).alias("taken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("row")).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rows and columns as they are.

    A document without words, null and empty texts included, is drawn by the number of documents alone; rows
    that agree in doc_id, source and size share one decision; the null source is a source of its own; an
    empty table gives none; columns beside those of documents go.
    """
    found = mixed(docs).select(F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"), F.col("size").alias("its_size"), "copies").filter("copies > 0")
    sized = docs.select(*DOCUMENT_COLUMNS, size_of(F.col("text")).alias("size"))
    both = sized.join(found, sized.doc_id.eqNullSafe(found.its_id) & sized.source.eqNullSafe(found.its_source) & (sized["size"] == found.its_size))
    return both.select(*DOCUMENT_COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
