"""Arms, clusters, contrast, the deterministic cluster bootstrap and the verdict."""

from __future__ import annotations

import hashlib
import struct
import uuid
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require
from ..session import shared_folder
from ..sources import files
from .jvm import drawn_sums
from .lineage import stored


def clusters(rows: DataFrame, owner: str, purchase: Column, sale: Column, value: str) -> DataFrame:
    """(idx, owner, p_n, p_sum, s_n, s_sum): each owner's rows and totals in both arms, numbered in order of owner.

    Owners are numbered within ranges of owners, and each range by how many are before it, so that no task
    has all of them.
    """
    v = F.col(value)
    found = rows.groupBy(owner).agg(F.count_if(purchase).alias("p_n"), F.coalesce(F.sum(F.when(purchase, v)), F.lit(0)).alias("p_sum"), F.count_if(sale).alias("s_n"), F.coalesce(F.sum(F.when(sale, v)), F.lit(0)).alias("s_sum"))
    return numbered(found.filter("p_n + s_n > 0"), owner)


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``idx``, their place in the order of a unique column, from 0."""
    dealt = stored(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    size = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(size):
        before[part] = total
        total += size[part]
    start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return dealt.withColumn("idx", (F.element_at(start, F.col("part")) + place).cast("int")).drop("part")


def contrast(rows: DataFrame, *by: str) -> DataFrame:
    """Difference of the arms' means, null where an arm is empty; clusters count as often as they occur."""
    part = lambda n, s: F.try_divide(F.sum(s).cast("double"), F.sum(n).cast("double"))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg((part("p_n", "p_sum") - part("s_n", "s_sum")).alias("contrast"))


#: Clusters to a block of sums (32 bytes each), blocks that an executor keeps, draws that a task takes at once, draws to a task, and to one that makes rows of them.
HELD, KEPT, STRETCH, DRAWS, ROWS = 1 << 20, 16, 1 << 22, 1 << 24, 1 << 21


def resampled(groups: DataFrame, domain: str, seed: int, resamples: int) -> DataFrame:
    """(resample, p_n, p_sum, s_n, s_sum): the clusters' sums, each as often as its resample draws it.

    A task draws whole resamples in the JVM and adds up whole numbers, so a resample leaves it as one row and no
    draw is shuffled, whatever the number of clusters: their sums lie in blocks in the shared folder, which
    an executor reads once for all its tasks, or if there are more than it keeps, one at a time. For sums that are no 64-bit integers, or if a draw was rejected (chance of
    some 2**-44 at a million clusters and 5,000 resamples), draws are made as rows and joined instead.
    """
    spark = groups.sparkSession
    columns = ["p_n", "p_sum", "s_n", "s_sum"]
    size, top = groups.agg(F.count("*"), F.greatest(*(F.max(F.abs(F.col(c).cast("decimal(38,0)"))) for c in columns))).first()
    whole = all(t in ("int", "bigint") or t.startswith("decimal") and t.endswith(",0)") for c, t in groups.dtypes if c in columns)
    if whole and size and size * int(top) < 1 << 62:
        folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
        write_blocks(groups.select("idx", *(F.col(c).cast("bigint") for c in columns)), folder, size, HELD)
        parts = min(resamples, max(1, -(-resamples * size // DRAWS), spark.sparkContext.defaultParallelism))
        fixed = F.lit(folder), F.lit(size).cast("bigint"), F.lit(HELD), F.lit(KEPT), F.lit(STRETCH), F.lit(domain.encode() + seed.to_bytes(8, "big"))
        sums = stored(spark.range(0, resamples, 1, parts).select(F.col("id").alias("resample"), drawn_sums(spark, F.col("id"), *fixed).alias("sums")))
        found = sums.select("resample", *(F.col("sums")[j].alias(c) for j, c in enumerate([*columns, "rejected"])))
        files.remove(spark, folder)
        if found.filter("rejected > 0").isEmpty():
            return found.select("resample", *columns)
    drawn = draws(spark, domain, seed, resamples, max(size, 1), max(8, -(-resamples * size // ROWS)))
    return drawn.join(groups, "idx").groupBy("resample").agg(*(F.sum(c).alias(c) for c in columns))


def write_blocks(groups: DataFrame, folder: str, size: int, each: int) -> None:
    """Files by number in ``folder``, each with the sums of ``each`` clusters in their order, as rows of 64-bit integers."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows, k = rows.sort_values("idx"), int(rows["block"].iloc[0])
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        aside = f"{at}/{k}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as sink:
            sink.write(np.ascontiguousarray(rows[["p_n", "p_sum", "s_n", "s_sum"]].to_numpy(np.int64)).tobytes())
        store.move(aside, f"{at}/{k}")
        return pd.DataFrame({"block": [k], "whole": [np.array_equal(rows["idx"].to_numpy(), np.arange(k * each, min((k + 1) * each, size)))]})

    placed = groups.withColumn("block", F.floor(F.col("idx") / each)).groupBy("block").applyInPandas(write, "block long, whole boolean").collect()
    if len(placed) != -(-size // each) or not all(r["whole"] for r in placed):
        raise ValueError("clusters are not numbered from 0 without a gap")


def draws(spark, domain: str, seed: int, resamples: int, size: int, partitions: int = 8) -> DataFrame:
    """(resample, position, idx): counter-mode SHA-256 draws below ``size``.

    A draw is the first eight bytes of the digest of the domain, the seed and the counter. Values at or
    beyond the largest multiple of ``size`` are rejected; then the counters are ranked anew, which is
    needed only if any is rejected, as otherwise a counter is its own rank.
    """
    limit = 2**64 // size * size
    spare = 0
    while True:
        rows = spark.range(0, resamples * size + spare, 1, partitions)
        message = F.concat(F.lit(domain.encode()), F.unhex(F.lit(f"{seed:016x}")), F.unhex(F.lpad(F.hex("id"), 16, "0")))
        word = F.conv(F.substring(F.sha2(message, 256), 1, 16), 16, 10).cast("decimal(20,0)")
        rows = rows.withColumn("word", word)
        if limit == 2**64:
            rejected = 0
        else:
            rejected = rows.filter(F.col("word") >= F.lit(str(limit)).cast("decimal(20,0)")).count()
        if rejected <= spare:
            break
        spare = rejected + 8
    k = F.col("id")
    if spare:
        kept = rows.filter(F.col("word") < F.lit(str(limit)).cast("decimal(20,0)"))
        rows = kept.withColumn("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("bigint")).filter(F.col("id") < resamples * size)
    idx = F.pmod(F.col("word"), F.lit(size).cast("decimal(20,0)")).cast("int")
    return rows.select(F.floor(k / size).cast("int").alias("resample"), (k % size).cast("int").alias("position"), idx.alias("idx"))


def index_digest(drawn: DataFrame) -> str:
    """sha256 over the draws in order as big-endian 64-bit integers; rows stream to the driver in order."""
    out = hashlib.sha256()
    for row in drawn.orderBy("resample", "position").toLocalIterator():
        out.update(struct.pack(">Q", row["idx"]))
    return out.hexdigest()


def bootstrap(sums: DataFrame) -> DataFrame:
    """(resamples, missing, lower, upper): nearest-rank 2.5 and 97.5 % of the contrasts of resamples, of which there are as many as a plan fixes."""
    each = contrast(sums, "resample")
    w = Window.orderBy("contrast")
    valid = each.filter("contrast IS NOT NULL").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    ends = valid.agg(F.max("n").alias("valid"), F.max(F.when(F.col("k") == F.expr("(n + 39) DIV 40"), F.col("contrast"))).alias("lower"), F.max(F.when(F.col("k") == F.expr("(39 * n + 39) DIV 40"), F.col("contrast"))).alias("upper"))
    total = each.agg(F.count("*").alias("resamples"), F.count_if(F.col("contrast").isNull()).alias("missing"))
    return total.crossJoin(ends)


def exact_bootstrap(sums: DataFrame, resamples: int) -> dict:
    """valid, missing, lower and upper as fractions, from whole-number sums of each resample; ``resamples`` rows come to the driver."""
    values = [v for v in (exact_contrast(r["p_n"], r["p_sum"], r["s_n"], r["s_sum"]) for r in sums.collect()) if v is not None]
    return {"resamples": resamples, "valid": len(values), "missing": resamples - len(values), "lower": nearest_rank(values, Fraction(1, 40)), "upper": nearest_rank(values, Fraction(39, 40))}


def exact_contrast(p_n: int, p_sum: int | Decimal, s_n: int, s_sum: int | Decimal) -> Fraction | None:
    return Fraction(p_sum) / p_n - Fraction(s_sum) / s_n if p_n and s_n else None


def nearest_rank(values: list[Fraction], probability: Fraction) -> Fraction | None:
    rank = -(-probability.numerator * len(values) // probability.denominator)
    return sorted(values)[max(1, rank) - 1] if values else None


def decimal50(value: Fraction | None) -> Decimal | None:
    """A fraction to 50 digits, half even."""
    if value is None:
        return None
    with localcontext() as c:
        c.prec, c.rounding = 50, ROUND_HALF_EVEN
        return Decimal(value.numerator) / Decimal(value.denominator)


#: Arms, cost scenarios in basis points, and the mechanics that a plan may not change.
ARMS, BPS = ("equity_purchase", "equity_sale"), (10, 25, 50)
FIXED = {"primary_horizon": 60, "secondary_horizons": (20, 90), "stock_round_trip_bps": BPS, "benchmark_round_trip_bps": 0, "resamples": 5000, "seed": 1729, "percentiles": (Decimal("0.025"), Decimal("0.975")), "maximum_missing_arm_fraction": Decimal("0.01"), "minimum_coverage_per_arm": Decimal("0.9")}


@dataclass(frozen=True)
class Plan:
    """An analysis plan: the fixed mechanics, and floors that a demonstration alone may lower."""

    purpose: str = "proposed_validation"
    minimum_complete_per_arm: int = 1000
    minimum_issuers_per_arm: int = 200
    features: tuple[str, ...] = ()
    mechanics: dict = field(default_factory=lambda: dict(FIXED))

    def __post_init__(self) -> None:
        if self.mechanics != FIXED or len(set(self.features)) != len(self.features):
            raise ValueError("unsupported analysis mechanics")
        if min(self.minimum_complete_per_arm, self.minimum_issuers_per_arm) < 1 or self.purpose == "proposed_validation" and (self.minimum_complete_per_arm, self.minimum_issuers_per_arm) != (1000, 200):
            raise ValueError("a validation needs 1000 complete events and 200 issuers in each arm")


def arm_summaries(rows: DataFrame, value: str, unit: int = 1, by_issuer: bool = True) -> DataFrame:
    """(horizon, arm, selected, actionable, complete, issuers, total, largest, issuer_counts): exact counts and sums by arm.

    Rows have horizon, event_type, selection, timing_eligible, status, issuer_id and the value. A complete
    row without an issuer or a value raises when it is read. issuer_counts has every issuer of an arm in one
    map, so who does not show it leaves it out by ``by_issuer``.
    """
    arm = F.col("event_type").isin(*ARMS) & (F.col("selection") == "selected")
    fit = F.col("timing_eligible")
    done = fit & (F.col("status") == "complete")
    rows = require(rows.filter(arm), ~done | (F.col("issuer_id").isNotNull() & F.col(value).isNotNull()), "a complete row without an issuer or a return")
    one = rows.groupBy("horizon", F.col("event_type").alias("arm"), "issuer_id").agg(F.count("*").alias("selected"), F.count_if(fit).alias("actionable"), F.count_if(done).alias("complete"), F.sum(F.when(done, F.col(value))).alias("total"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("complete") > 0, F.struct(F.col("issuer_id").cast("string"), "complete")))))
    shown = [counts.alias("issuer_counts")] if by_issuer else []
    return one.groupBy("horizon", "arm").agg(F.sum("selected").alias("selected"), F.sum("actionable").alias("actionable"), F.sum("complete").alias("complete"), F.count_if(F.col("complete") > 0).alias("issuers"), F.sum("total").alias("total"), F.max("complete").alias("largest"), *shown)


def rounded(summary: dict, unit: int) -> dict:
    """The fractions of an arm's summary, to 50 digits: coverage, largest issuer's share, gross and net means."""
    n = summary["complete"]
    mean = Fraction(summary["total"]) / n / unit if n else None
    net = {str(b): decimal50(mean - Fraction(b, 10000)) if mean is not None else None for b in BPS}
    return summary | {"coverage": decimal50(Fraction(n, summary["actionable"])) if summary["actionable"] else None, "largest_fraction": decimal50(Fraction(summary["largest"], n)) if n else None, "gross_mean": decimal50(mean), "net_means": net}


def verdict(arms: dict[str, dict], boot: dict, net25: Fraction | None, plan: Plan) -> tuple[str, list[str]]:
    """insufficient, negative or positive, with every reason, by exact comparison. ``arms`` has complete, issuers and actionable."""
    lacking = []
    for name in ARMS:
        arm = arms.get(name) or {"complete": 0, "issuers": 0, "actionable": 0}
        if arm["complete"] < plan.minimum_complete_per_arm:
            lacking.append(f"{name}:complete_events_below_minimum")
        if arm["issuers"] < plan.minimum_issuers_per_arm:
            lacking.append(f"{name}:complete_issuers_below_minimum")
        if not arm["actionable"] or Fraction(arm["complete"], arm["actionable"]) < Fraction(plan.mechanics["minimum_coverage_per_arm"]):
            lacking.append(f"{name}:actionable_coverage_below_minimum_or_undefined")
    if boot["resamples"] and Fraction(boot["missing"], boot["resamples"]) > Fraction(plan.mechanics["maximum_missing_arm_fraction"]):
        lacking.append("missing_arm_resamples_above_maximum")
    if boot["lower"] is None or net25 is None:
        lacking.append("undefined_primary_statistics")
    bad = []
    if boot["lower"] is not None and boot["lower"] <= 0:
        bad.append("contrast_lower_not_strictly_positive")
    if net25 is not None and net25 <= 0:
        bad.append("purchase_net25_not_strictly_positive")
    return "insufficient" if lacking else "negative" if bad else "positive", lacking + bad


def analyze_horizon(rows: DataFrame, value: str, unit: int, horizon: int, plan: Plan, domain: str, by_issuer: bool = True) -> dict:
    """One horizon's arms, and for the primary one clusters, bootstrap and verdict. Values are whole numbers of 1 / unit; ``by_issuer`` as for summaries."""
    rows = rows.filter(F.col("horizon") == horizon)
    arms = {r["arm"]: r.asDict() for r in arm_summaries(rows, value, by_issuer=by_issuer).collect()}
    shown = {name: rounded(arm, unit) for name, arm in sorted(arms.items())}
    if horizon != plan.mechanics["primary_horizon"]:
        return {"horizon": horizon, "arms": shown, "bootstrap": None, "verdict": "not_evaluated", "reasons": ["secondary_descriptive_endpoint_cannot_rescue_primary"]}
    done = rows.filter((F.col("selection") == "selected") & F.col("timing_eligible") & (F.col("status") == "complete") & F.col("event_type").isin(*ARMS))
    groups = stored(clusters(done, "issuer_id", F.col("event_type") == ARMS[0], F.col("event_type") == ARMS[1], value))
    size, resamples = groups.count(), plan.mechanics["resamples"]
    boot = exact_bootstrap(resampled(groups.select("idx", "p_n", "p_sum", "s_n", "s_sum"), domain, plan.mechanics["seed"], resamples), resamples) if size else {"resamples": resamples, "valid": 0, "missing": resamples, "lower": None, "upper": None}
    purchase = arms.get(ARMS[0])
    net25 = Fraction(purchase["total"]) / purchase["complete"] / unit - Fraction(25, 10000) if purchase and purchase["complete"] else None
    boot = boot | {k: None if boot[k] is None else boot[k] / unit for k in ("lower", "upper")} | {"clusters": size}
    whole = groups.agg(*(F.sum(c).alias(c) for c in ("p_n", "p_sum", "s_n", "s_sum"))).first()
    boot["contrast"] = exact_contrast(*(whole[c] or 0 for c in ("p_n", "p_sum", "s_n", "s_sum")))
    boot["contrast"] = None if boot["contrast"] is None else boot["contrast"] / unit
    found, reasons = verdict(arms, boot, net25, plan)
    return {"horizon": horizon, "arms": shown, "bootstrap": boot, "verdict": found, "reasons": reasons or ["all_proposed_conditions_met_conditional_only"]}


def missingness_shift(contrast_: Fraction, net25: Fraction, missing_purchase: Fraction, missing_sale: Fraction, worst: Fraction = Fraction(1, 10)) -> tuple[Fraction, Fraction]:
    """Contrast and net return if the rows that are missing in each arm were worse by ``worst``."""
    return contrast_ - (missing_purchase + missing_sale) * worst, net25 - missing_purchase * worst


#: A study of paired episodes, in sessions and floors of each episode.
EPISODE = {"entry_sessions": 60, "guard_sessions": 60, "stride": 180, "events": 20, "issuers": 10, "coverage": Fraction(9, 10), "episodes": 12}


def episodes(rows: DataFrame, value: str) -> DataFrame:
    """(episode, arm, complete, actionable, issuers, total, usable): rows by episode of their entry session; guard sessions are in none."""
    at = F.col("entry_ord") - 1
    inside = rows.filter(at.isNotNull() & (at % EPISODE["stride"] < EPISODE["entry_sessions"])).withColumn("episode", F.floor(at / EPISODE["stride"]).cast("int"))
    done = F.col("status") == "complete"
    found = inside.groupBy("episode", "arm").agg(F.count_if(done).alias("complete"), F.count_if(~F.col("status").isin("excluded", "rejected")).alias("actionable"), F.count_distinct(F.when(done, F.col("issuer_id"))).alias("issuers"), F.coalesce(F.sum(F.when(done, F.col(value))), F.lit(0)).alias("total"))
    covered = F.col("complete") * EPISODE["coverage"].denominator >= F.col("actionable") * EPISODE["coverage"].numerator
    return found.withColumn("usable", (F.col("complete") >= EPISODE["events"]) & (F.col("issuers") >= EPISODE["issuers"]) & covered)


def episode_veto(found: DataFrame) -> dict:
    """Equal-weight means over the episodes that both arms may use, and whether there are enough and all agree."""
    both = found.filter("usable").groupBy("episode").pivot("arm", ["purchase", "sale"]).agg(F.first("total").alias("total"), F.first("complete").alias("n")).dropna()
    pairs = [(Fraction(r["purchase_total"]) / r["purchase_n"], Fraction(r["sale_total"]) / r["sale_n"]) for r in both.orderBy("episode").collect()]
    n = len(pairs)
    mean = sum((p - s for p, s in pairs), Fraction()) / n if n else None
    return {"episodes": n, "enough": n >= EPISODE["episodes"], "mean_contrast": mean, "vetoed": n < EPISODE["episodes"] or mean <= 0}


def common_shock(purchase: Fraction, sale: Fraction, shock: Fraction, issuers: int) -> dict[str, dict]:
    """Two states of one shock that all purchases share: what a bootstrap over issuers reports in each.

    Every issuer of a state has the same pair of means, so every resample has the same contrast: the
    interval is a point, on one side or the other, though the mean over both states is between them.
    """
    states = {}
    for name, sign in (("down", -1), ("up", 1)):
        p = purchase + sign * shock
        values = [exact_contrast(issuers, p * issuers, issuers, sale * issuers)]
        states[name] = {"contrast": values[0], "lower": nearest_rank(values, Fraction(1, 40)), "upper": nearest_rank(values, Fraction(39, 40)), "net25": p - Fraction(25, 10000)}
    return states
