"""Range joins by aligned spans, against every pair."""

import datetime as dt
import random

from pyspark.sql import functions as F

from keelson.operators import intervals

DAY = dt.date(2000, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def test_spans_make_up_each_interval_once(spark):
    rows = [(a, b) for a in range(17) for b in range(a, 17)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals.dyadic(F.col("a"), F.col("b"), 4).alias("s"))
    for r in df.collect():
        days = [d for level, span in r["s"] for d in range(span << level, (span + 1) << level)]
        assert sorted(days) == list(range(r["a"], r["b"])) and len(r["s"]) <= 8


def test_range_join_is_every_pair_that_holds(spark):
    rng = random.Random(9)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(400)])) for i in range(500)] * 2
    right = [(j, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-50, 400)]), rng.choice([None, *range(0, 450)])) for j in range(200)]
    a = spark.createDataFrame([(i, k, at(d)) for i, k, d in left], "i int, k int, day date")
    b = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in right], "j int, k int, s date, e date")
    got = sorted((r["i"], r["j"] if r["j"] is not None else -1) for r in intervals.range_join(a, b, "k", "day", "s", "e").collect())
    want = []
    for i, k, d in left:
        hits = [j for j, k2, s, e in right if k is not None and k == k2 and d is not None and (s is None or d >= s) and (e is None or d < e)]
        want += [(i, j) for j in hits] or [(i, -1)]
    assert got == sorted(want)


def test_range_join_of_empty_sides_and_one_day(spark):
    a = spark.createDataFrame([(1, 7, at(3))], "i int, k int, day date")
    b = spark.createDataFrame([(5, 7, None, None), (6, 7, at(3), at(3)), (8, 7, at(4), None)], "j int, k int, s date, e date")
    assert [(r["i"], r["j"]) for r in intervals.range_join(a, b, "k", "day", "s", "e").collect()] == [(1, 5)]
    assert intervals.range_join(a, b.limit(0), "k", "day", "s", "e").collect()[0]["j"] is None
    assert intervals.range_join(a.limit(0), b, "k", "day", "s", "e").count() == 0


def test_a_hot_keys_intervals_are_spread(spark):
    days = spark.range(2000).select(F.lit(1).alias("k"), F.expr("date_add(DATE '2000-01-01', CAST(id AS int))").alias("day"))
    held = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("j"), F.expr("date_add(DATE '2000-01-01', CAST(id % 2000 AS int))").alias("s"), F.expr("date_add(DATE '2000-01-01', CAST(id % 2000 + 1 + id % 3 AS int))").alias("e"))
    found = intervals.range_join(days, held, "k", "day", "s", "e")
    assert found.count() == held.selectExpr("sum(least(datediff(e, s), 2000 - CAST(j % 2000 AS int)))").first()[0]
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(found._jdf.queryExecution().toString().split())
