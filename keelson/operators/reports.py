"""Aggregates of outcome rows: exact counts, ranks and cross-tables."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import at_ranks


def histogram(rows: DataFrame, by: str, status: str, values: tuple[str, ...]) -> DataFrame:
    """(by, status, n) for all statuses, zero where there is none."""
    wide = rows.groupBy(by).pivot(status, list(values)).count().fillna(0)
    return wide.unpivot(by, list(values), status, "n")


def crosstab(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by all columns and each prefix of them, totals included; level is the number of columns that are fixed."""
    level = sum((1 - F.grouping(c) for c in columns[1:]), 1 - F.grouping(columns[0]))
    return rows.rollup(*columns).agg(F.count("*").alias("n"), level.cast("int").alias("level"))


#: Ranks of a group of n: the two that its median lies between, and the nearest ranks of its first and last decile.
RANKS = {"m1": lambda n: F.floor((n + 1) / 2), "m2": lambda n: F.floor(n / 2) + 1, "p10": lambda n: F.floor((n + 9) / 10), "p90": lambda n: F.floor((9 * n + 9) / 10)}


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, twice the median, extremes, nearest-rank deciles and the number above zero, by group, from whole ranks."""
    mean = F.round(F.col("sum") / F.col("n")).cast("bigint").alias("mean")
    return at_ranks(rows, by, value, RANKS).select(by, "n", mean, (F.col("m1") + F.col("m2")).alias("median_x2"), "low", "high", "p10", "p90", "positive")


def largest_share(rows: DataFrame, by: str, owner: str) -> DataFrame:
    """How many rows, owners, and rows of the largest owner each group has."""
    return rows.groupBy(by, owner).agg(F.count("*").alias("c")).groupBy(by).agg(F.sum("c").alias("rows"), F.count("*").alias("owners"), F.max("c").alias("largest"))


def repeated_excess(rows: DataFrame, *key: str) -> DataFrame:
    """groups and excess: keys that occur more than once, and their rows beyond the first."""
    c = F.col("c")
    return rows.groupBy(*key).agg(F.count("*").alias("c")).agg(F.count_if(c > 1).alias("groups"), F.coalesce(F.sum(F.when(c > 1, c - 1)), F.lit(0)).alias("excess"))


def first_k(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The first k distinct values of each group, in order."""
    return rows.select(by, value).distinct().withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(value))).filter(F.col("k") <= k)


def exact_distribution(rows: DataFrame, by: str, value: str, unit: int = 1) -> dict:
    """By group: n and, to 50 digits, mean, median, extremes, nearest-rank deciles and the share above zero.

    Values are whole numbers of 1 / unit. Ranks and sums are taken in the cluster; the driver divides.
    """
    def shown(x: Fraction) -> Decimal:
        with localcontext() as c:
            c.prec, c.rounding = 50, ROUND_HALF_EVEN
            return Decimal(x.numerator) / Decimal(x.denominator)

    found = at_ranks(rows, by, value, RANKS).withColumn("twice", F.col("m1") + F.col("m2"))
    out = {}
    for r in found.collect():
        f = lambda x, d=1: shown(Fraction(x) / d / unit)
        out[r[by]] = {"n": r["n"], "mean": f(r["sum"], r["n"]), "median": f(r["twice"], 2), "minimum": f(r["low"]), "maximum": f(r["high"]), "p10": f(r["p10"]), "p90": f(r["p90"]), "positive_fraction": shown(Fraction(r["positive"], r["n"]))}
    return out


def count_map(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(by, counts): how many rows of each group have each key, as a map in order of the key; null is 'none'."""
    one = rows.groupBy(by, F.coalesce(F.col(key).cast("string"), F.lit("none")).alias("key")).count()
    return one.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "count")))).alias("counts"))
