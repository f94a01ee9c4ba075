"""Half-open intervals: range joins with an unknown outcome, overlaps, gaps and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored
from .scans import running


def holds_on(day: Column, start: Column, end: Column, unknown: Column | None = None) -> Column:
    """Whether [start, end) holds on a day; open where null; null where a bound is unknown."""
    inside = (F.coalesce(day >= start, F.lit(True))) & (F.coalesce(day < end, F.lit(True)))
    return inside if unknown is None else F.when(~unknown, inside)


def dyadic(start: Column, end: Column, bits: int) -> Column:
    """The aligned power-of-two spans that make up the whole numbers [start, end) below 2**bits: structs of level and span.

    A level adds its first span if that is a right child, and its last one if that is a left child; there
    are at most two on each of the levels.
    """
    spans = []
    for level in range(bits + 1):
        first, last = F.shiftright(start + ((1 << level) - 1), level), F.shiftright(end, level)
        for taken, span in ((first % 2 == 1, first), (last % 2 == 1, last - 1)):
            spans.append(F.when((first < last) & taken, F.struct(F.lit(level).alias("level"), span.alias("span"))))
    return F.array_compact(F.array(*spans))


def range_join(left: DataFrame, right: DataFrame, key: str, day: str, start: str, end: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of one key whose interval holds on the day; none is lost.

    An equi-join: an interval is cut into aligned spans of days, and a day looks for each span that it lies
    in, on the levels that intervals have. So a key's intervals are spread over tasks by their spans, and a
    day meets only intervals that hold on it. Days are counted from the first to the last that ``left`` has,
    and intervals clipped to them, open ends included.
    """
    numbered = stored(left.withColumn("its_row", F.monotonically_increasing_id()))
    first, last = numbered.agg(F.min(F.unix_date(day)), F.max(F.unix_date(day))).first()
    others = [c for c in right.columns if c != key]
    if first is None:
        return left.join(right.select(*others).limit(0), F.lit(False), "left")
    bits = (last - first).bit_length()
    clipped = lambda c, default: F.least(F.greatest(F.coalesce(F.unix_date(c) - first, F.lit(default)), F.lit(0)), F.lit(last - first + 1)).cast("bigint")
    cut = right.select(F.col(key).alias("its_key"), *others, F.explode(dyadic(clipped(start, 0), clipped(end, last - first + 1), bits)).alias("at"))
    cut = stored(cut.filter("its_key IS NOT NULL"))
    levels = sorted(r[0] for r in cut.select("at.level").distinct().collect())  # some 14 at most for 40 years
    if not levels:
        return numbered.drop("its_row").join(cut.drop("its_key", "at").limit(0), F.lit(False), "left")
    place = (F.unix_date(day) - first).cast("bigint")
    probes = numbered.withColumn("probe", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(place, n).alias("span")) for n in levels))))
    met = probes.join(cut, (F.col(key) == F.col("its_key")) & (F.col("probe.level") == F.col("at.level")) & (F.col("probe.span") == F.col("at.span")))
    met = met.drop("probe", "at", "its_key")
    missed = numbered.join(met.select("its_row"), "its_row", "left_anti").select(*left.columns, "its_row", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others))
    return met.unionByName(missed.select(*met.columns)).drop("its_row")


def overlaps_before(rows: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Rows with ``overlapping``: the interval before, by start, is open or ends after this one's start."""
    w = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_first(), tie)
    before = F.row_number().over(w) > 1
    clash = before & (F.lag(end).over(w).isNull() | F.col(start).isNull() | (F.col(start) < F.lag(end).over(w)))
    return rows.withColumn("overlapping", clash)


def gaps(rows: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """(key, gap_start, gap_end): stretches between a key's first start and last end that no interval covers."""
    w = Window.partitionBy(key).orderBy(start, end, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, reach.alias("gap_start"), F.col(start).alias("gap_end")).filter("gap_start < gap_end")


def uncovered(rows: DataFrame, key: str, start: str, end: str, first: Column, last: Column) -> DataFrame:
    """(key, gap_start, gap_end): what a key's half-open intervals leave open of the closed days [first, last]; open bounds reach beyond."""
    lo, hi = F.coalesce(F.greatest(F.col(start), first), first), F.coalesce(F.least(F.col(end), F.date_add(last, 1)), F.date_add(last, 1))
    inside = rows.select(key, lo.alias("a"), hi.alias("b")).filter("a < b")
    edge = rows.select(key).distinct().select(key, F.date_add(last, 1).alias("a"), F.date_add(last, 1).alias("b"))
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), first)
    return inside.union(edge).select(key, reach.alias("gap_start"), F.col("a").alias("gap_end")).filter("gap_start < gap_end")


def sweep(rows: DataFrame, start: str, end: str, owner: str, partition: str) -> DataFrame:
    """(partition, peak_active, peak_owners, peak_repeats): the most closed intervals at once, in each partition.

    An interval that starts when another ends counts with it. Steps are summed by instant first, and both
    running sums (an owner's, then the partition's) go by ranges of time, so that neither an owner nor a
    partition with all rows is one task.
    """
    edge = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step"))))
    edges = rows.select(partition, owner, edge.alias("e")).groupBy(partition, owner, F.col("e.at").alias("at"), F.col("e.kind").alias("kind")).agg(F.sum("e.step").alias("step"))
    counted = running(edges, [partition, owner], ["at", "kind"], n="step").withColumn("before", F.col("n") - F.col("step"))
    counted = counted.withColumn("owners", F.when((F.col("before") == 0) & (F.col("n") > 0), 1).when((F.col("before") > 0) & (F.col("n") == 0), -1).otherwise(0))
    steps = counted.groupBy(partition, "at", "kind").agg(F.sum("step").alias("step"), F.sum("owners").alias("owners"))
    run = running(steps, [partition], ["at", "kind"], active="step", distinct="owners")
    return run.groupBy(partition).agg(F.max("active").alias("peak_active"), F.max("distinct").alias("peak_owners"), F.max(F.col("active") - F.col("distinct")).alias("peak_repeats"))


def interval_overlaps(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], bucket_days: int = 64) -> DataFrame:
    """Pairs whose closed date intervals overlap, each once: an equi-join on buckets of days, then the test.

    A pair counts in the bucket where its overlap begins, so that long intervals give no pair twice.
    """
    a, b, c, d = (*left_bounds, *right_bounds)
    bucket = lambda x: F.floor(F.unix_date(x) / bucket_days)
    spread = lambda df, x, y, n: df.withColumn(n, F.explode(F.sequence(bucket(F.col(x)), bucket(F.col(y)))))
    pairs = spread(left, a, b, "bucket_a").join(spread(right, c, d, "bucket_b"), F.col("bucket_a") == F.col("bucket_b"))
    return pairs.filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("bucket_a") == bucket(F.greatest(F.col(a), F.col(c))))).drop("bucket_a", "bucket_b")
