"""Running sums and ranks by ranges, against the sort; no task has a whole key."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from keelson.operators import intervals, reports, scans


@pytest.fixture(autouse=True)
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sums_over_one_key_with_all_rows(spark):
    rng = random.Random(2)
    rows = [(k, at, rng.randint(-3, 3)) for k in ("hot", None, "one") for at in range({"hot": 4000, "one": 1}.get(k, 30))]
    df = spark.createDataFrame(rows, "k string, at int, step int").repartition(5)
    assert scans.dealt(df, "k", "at").filter("k = 'hot'").select("part").distinct().count() > 1
    got = {(r["k"], r["at"]): (r["total"], r["twice"]) for r in scans.running(df.withColumn("d", F.col("step") * 2), ["k"], ["at"], total="step", twice="d").collect()}
    for key in ("hot", None, "one"):
        want = list(accumulate(s for k, _, s in rows if k == key))
        assert [got[key, at] for at in range(len(want))] == [(w, 2 * w) for w in want]


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)"])
def test_ranks_are_those_of_the_sort(spark, kind):
    rng = random.Random(4)
    groups = {1: [rng.randint(-50, 50) for _ in range(3000)], 2: [7], 3: [5, 5, 5, 5], 4: [None], 5: [-(10**12), 10**12], None: [rng.randint(-(2**40), 2**40) for _ in range(501)], 6: [1, 2, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v long").withColumn("v", F.col("v").cast(kind)).repartition(3)
    got = {r["g"]: r for r in reports.distribution(df, "g", "v").collect()}
    assert 4 not in got and len(got) == 6
    for g, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        n = len(s)
        if n:
            want = (n, s[(n + 1) // 2 - 1] + s[n // 2], s[0], s[-1], s[(n + 9) // 10 - 1], s[(9 * n + 9) // 10 - 1], sum(v > 0 for v in s))
            assert tuple(got[g][c] for c in ("n", "median_x2", "low", "high", "p10", "p90", "positive")) == want


def test_sweep_of_one_hot_owner(spark):
    rng = random.Random(6)
    rows = [("p", "hot" if rng.random() < 0.6 else f"o{rng.randint(0, 9)}", a := rng.randint(0, 900), a + rng.randint(0, 40)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "p string, owner string, a int, b int")
    active = [[r[1] for r in rows if r[2] <= t <= r[3]] for t in range(950)]
    want = (max(map(len, active)), max(len(set(x)) for x in active), max(len(x) - len(set(x)) for x in active))
    assert tuple(intervals.sweep(df, "a", "b", "owner", "p").first())[1:] == want
