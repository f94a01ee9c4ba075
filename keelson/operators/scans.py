"""Running sums and exact ranks by ranges: what a window over a whole key would put into one task.

Rows are dealt by ranges of (key, order). Each range gives its sums, the sums of the ranges before it are
carried to it, and only inside a range are rows sorted and added up. A key of any size is spread over as
many ranges as it fills; what is windowed over a whole key has a row for each of its ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """The rows by ranges of the columns, with ``part``, which ascends with them; stored, so that both passes see the same ranges.

    They are stored before as well, as ranges are found by a sample, for which the rows would be made once more.
    """
    return stored(stored(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys of which nulls are equal; the other's keys are dropped."""
    named = other.select(*(F.col(k).alias(f"its_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in keys]).drop(*(f"its_{k}" for k in keys))


def running(rows: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """Rows with the sum of a column up to and including each row, in an order without ties, by key: ``running(..., total="step")``."""
    split = dealt(rows, *keys, *order)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    net = split.groupBy(*keys, "part").agg(*(F.sum(c).alias(f"net_{n}") for n, c in sums.items()))
    carried = net.select(*keys, "part", *(F.coalesce(F.sum(f"net_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = beside(split, carried, [*keys, "part"]).withColumns({n: F.sum(c).over(inside) + F.col(f"before_{n}") for n, c in sums.items()})
    return found.drop("part", *(f"before_{n}" for n in sums))


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, sum, low, high, positive, and a value for each rank): exact order statistics of each group's values that are not null.

    A rank is a function of the group's size, from 1. Equal values are counted first, so ties can't fill a
    range; and only ranges that hold a rank are sorted.
    """
    counts = dealt(rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c")), by, value)
    v, c = F.col(value), F.col("c")
    pieces = stored(counts.groupBy(by, "part").agg(F.sum("c").alias("piece"), F.sum(v * c).alias("sum"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(F.when(v > 0, c).otherwise(0)).alias("positive")))
    whole = pieces.groupBy(by).agg(F.sum("piece").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("positive").alias("positive"))
    upto = pieces.select(by, "part", F.sum("piece").over(Window.partitionBy(by).orderBy("part")).alias("upto"), "piece", F.sum("piece").over(Window.partitionBy(by)).alias("n"))
    asked = upto.withColumn("ask", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for name, rank in ranks.items()))))
    before = F.col("upto") - F.col("piece")
    asked = asked.filter((F.col("ask.rank") > before) & (F.col("ask.rank") <= F.col("upto"))).select(by, "part", F.col("ask.name").alias("name"), (F.col("ask.rank") - before).alias("rank"))
    held = beside(counts, asked.select(by, "part").distinct(), [by, "part"])
    held = held.withColumn("reach", F.sum("c").over(Window.partitionBy(by, "part").orderBy(value)))
    met = beside(held, asked, [by, "part"]).filter((F.col("rank") <= F.col("reach")) & (F.col("rank") > F.col("reach") - F.col("c")))
    found = met.groupBy(by).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks))
    return beside(whole, found, [by])
