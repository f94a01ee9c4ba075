"""Lineage and integrity: orphans, closure, exact cover, independent families and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import require
from ..session import shared_folder


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no target; null references are not references."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("its_key")), F.col(key) == F.col("its_key"), "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root, steps) of every node with a parent, from (node, parent) with one parent to a node at most; a cycle raises.

    Pointers double: each round sends a node on to where its present target points, so that rounds go with
    the logarithm of the depth, and no round has more rows than there are nodes.
    """
    jump = stored(edges.select("node", "parent").filter("parent IS NOT NULL").distinct())
    n = jump.count()
    if jump.select("node").distinct().count() != n:
        raise ValueError("a node has two parents")
    ends = jump.select(F.col("parent").alias("root")).join(jump.select(F.col("node").alias("root")), "root", "left_anti").distinct().withColumn("done", F.lit(True))
    jump = stored(jump.join(ends, F.col("parent") == F.col("root"), "left").select("node", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("steps"), F.coalesce("done", F.lit(False)).alias("done")))
    for _ in range(n.bit_length() + 1):
        active = jump.filter(~F.col("done"))
        if active.isEmpty():
            return jump.select("node", F.col("at").alias("root"), "steps")
        target = jump.select(F.col("node").alias("at"), F.col("at").alias("on"), F.col("steps").alias("more"), F.col("done").alias("last"))
        moved = active.join(target, "at").select("node", F.col("on").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("last").alias("done"))
        jump = stored(jump.filter("done").union(moved))
    raise ValueError("lineage has a cycle")


def check_acyclic(edges: DataFrame) -> None:
    """Raises if (node, parent) has a cycle, without pairs of ancestors.

    Where no node has two parents, pointers double. Else rounds peel edges that no cycle can use (to a node
    without a parent, from one without a child), and take nodes with one parent and one child out of their
    chains, each with a chance of a quarter or more; so chains and trees take rounds by the logarithm of
    their size. A cycle shrinks to an edge from a node to itself.
    """
    left = stored(edges.select("node", "parent").filter("parent IS NOT NULL").distinct())
    if left.count() == left.select("node").distinct().count():
        roots(left)
        return
    turn = 0
    while not left.isEmpty():
        if not left.filter("node = parent").isEmpty():
            raise ValueError("lineage has a cycle")
        children, parents = left.select(F.col("node").alias("parent")).distinct(), left.select(F.col("parent").alias("node")).distinct()
        left = stored(left.join(children, "parent", "left_semi").join(parents, "node", "left_semi").select("node", "parent"))
        up = left.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("above")).filter("n = 1").select(F.col("node").alias("middle"), "above")
        down = left.groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("below")).filter("n = 1").select(F.col("parent").alias("middle"), "below")
        coin = lambda c: F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0
        middles = stored(up.join(down, "middle").filter("middle <> above"))
        held = middles.select(F.col("middle").alias("above"), coin("middle").alias("heads"))
        # of two neighbours in a chain not both go: one goes on heads if what stands above it stays
        taken = stored(middles.filter(coin("middle")).join(held, "above", "left").filter(~F.coalesce("heads", F.lit(False))).select("middle", "above", "below"))
        gone = taken.select("middle")
        left = left.join(gone.select(F.col("middle").alias("node")), "node", "left_anti").join(gone.select(F.col("middle").alias("parent")), "parent", "left_anti").select("node", "parent")
        left = stored(left.union(taken.select(F.col("below").alias("node"), F.col("above").alias("parent"))).distinct())
        turn += 1


def ancestors(spark: SparkSession, edges: DataFrame, depth: int = 128) -> DataFrame:
    """(node, ancestor, steps) with each node as its own ancestor at zero, from (node, parent); deeper than ``depth`` raises, and so does a cycle.

    Steps double: what is known of fewer than 2**k steps is joined with the pairs of exactly 2**k, and those
    with themselves, so a lineage of 128 generations takes eight rounds. Rounds are written to the shared
    folder. A cycle has pairs of any length, so what is too deep is looked into for one.
    """
    exact = stored(edges.select("node", F.col("parent").alias("ancestor")).filter("ancestor IS NOT NULL").distinct())
    known = stored(edges.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")).distinct())
    length = 1
    while not exact.isEmpty():
        if length > depth:
            check_acyclic(edges)
            raise ValueError(f"lineage is deeper than {depth}")
        onward = exact.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("on"))
        reached = known.join(onward, "ancestor").select("node", F.col("on").alias("ancestor"), (F.col("steps") + length).alias("steps"))
        known = stored(known.union(reached).distinct())
        exact = stored(exact.join(exact.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("on")), "ancestor").select("node", F.col("on").alias("ancestor")).distinct())
        length *= 2
    if not known.filter(F.col("steps") > depth).isEmpty():
        raise ValueError(f"lineage is deeper than {depth}")
    return known


def stored(rows: DataFrame) -> DataFrame:
    """The rows without their lineage, in the folder that the session's checkpoints go to."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def cover(declared: DataFrame, actual: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys with ``state``: match, changed, missing (declared only) or undeclared (actual only)."""
    a, b = declared.alias("a"), actual.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    here, there = F.col(f"a.{digest}").isNotNull(), F.col(f"b.{digest}").isNotNull()
    state = F.when(here & there & (F.col(f"a.{digest}") == F.col(f"b.{digest}")), "match").when(here & there, "changed").when(here, "missing").otherwise("undeclared")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), state.alias("state"))


def families(rows: DataFrame, key: str, family: str, primary: Column) -> DataFrame:
    """Each key's distinct families among primary rows, sorted and joined; 'unanchored' without any."""
    found = F.array_join(F.array_sort(F.collect_set(F.when(primary, F.col(family)))), "+")
    return rows.groupBy(key).agg(F.coalesce(F.nullif(found, F.lit("")), F.lit("unanchored")).alias("families"))


def differences(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of either side that the other lacks, with their multiplicity; both empty if the sides are equal."""
    return left.exceptAll(right), right.exceptAll(left)


def compared(parent: DataFrame, candidate: DataFrame, keys: list[str], digest: str, mutable: Column | None = None) -> DataFrame:
    """Keys with what a candidate does to its parent: same, added, removed, changed, or allowed where ``mutable`` holds for the key."""
    both = cover(parent, candidate, keys, digest)
    free = mutable if mutable is not None else F.lit(False)
    state = F.col("state")
    return both.withColumn("state", F.when(state == "match", "same").when(state == "undeclared", "added").when(state == "missing", "removed").when(free, "allowed").otherwise("changed"))


def merged_claims(*parts: DataFrame, key: str = "external_identifier_id") -> DataFrame:
    """Claims of several sources as one, where equal ones are one; two different ones of a key raise when read."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    one = every.distinct()
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    return require(one.withColumn("twice", twice), ~F.col("twice"), "one claim with two payloads").drop("twice")


def appended(existing: DataFrame, additions: DataFrame | None) -> DataFrame:
    """Existing records with what an optional enrichment adds; without a result they stay as they are."""
    return existing if additions is None else existing.unionByName(additions).distinct()


def subset(a: Column, b: Column) -> Column:
    """Whether all elements of an array are in another."""
    return F.size(F.array_except(a, b)) == 0
