"""Ancestors, roots and cycles, against walks in Python."""

import random

import pytest

from keelson.operators import lineage


def frame(spark, edges):
    return spark.createDataFrame(edges, "node long, parent long")


def walked(edges):
    up = {}
    for n, p in edges:
        up.setdefault(n, set()).update([p] if p is not None else [])
    out = set()
    for n in up:
        level, steps = {n}, 0
        while level:
            out |= {(n, a, steps) for a in level}
            level, steps = {p for a in level for p in up.get(a, ())}, steps + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_of_a_graph_with_many_parents(spark, seed):
    rng = random.Random(seed)
    edges = [(n, rng.randint(0, n - 1) if rng.random() < 0.9 else None) for n in range(1, 40) for _ in range(rng.choice([1, 1, 2]))]
    got = {tuple(r) for r in lineage.ancestors(spark, frame(spark, edges)).collect()}
    assert got == walked(edges)
    lineage.check_acyclic(frame(spark, edges))
    for n, p in ((3, 3), (0, 39)):
        reach = {a for x, a, _ in walked(edges) if x == p} | {p}
        if n in reach:  # the edge closes a cycle
            with pytest.raises(ValueError, match="cycle"):
                lineage.check_acyclic(frame(spark, [*edges, (n, p)]))


def test_a_cycle_among_many_parents_raises(spark):
    ring = [(n, (n + 1) % 9) for n in range(9)]
    with pytest.raises(ValueError, match="cycle"):
        lineage.check_acyclic(frame(spark, [*ring, (20, 3), (20, 4), (3, 30)]))
    diamond = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 7)]
    lineage.check_acyclic(frame(spark, diamond))


def test_a_chain_of_100000_nodes(spark):
    chain = spark.range(1, 100_001).selectExpr("id AS node", "id - 1 AS parent")
    found = lineage.roots(chain)
    assert found.filter("root = 0 AND steps = node").count() == 100_000
    with pytest.raises(ValueError, match="cycle"):
        lineage.roots(chain.union(spark.createDataFrame([(0, 77_777)], "node long, parent long")))
    with pytest.raises(ValueError, match="two parents"):
        lineage.roots(frame(spark, [(1, 2), (1, 3)]))
    assert lineage.roots(frame(spark, [])).count() == 0


def test_a_key_that_comes_twice_raises(spark):
    from pyspark.errors import PySparkException

    from keelson.operators import assembly

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k long, v string")
    assert assembly.once(rows, "k", "twice").count() == 4
    with pytest.raises(PySparkException, match="twice"):
        assembly.once(rows.union(rows.filter("k = 1")), "k", "twice").collect()
