"""Near copies by word shingles: candidates that share a band of MinHash values, decided by exact Jaccard similarity.

Texts with equal sets of shingles are one node, named by a 128-bit hash of the set. Nodes that share a
band's key stand in one bucket. A small bucket gives its pairs. The members of a large one are dealt to
blocks of bounded bytes, and two blocks meet in a tile, whose task compares the sets themselves and sends
on a forest of links, never the pairs. First every block meets the bucket's first one, which is linear in
the bucket; then only what is not yet of the bucket's largest component meets the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, column_bytes, components, kept, lean, mix64, runs

#: Words of a shingle, and the least Jaccard similarity of near copies, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bands of MinHash values and values of a band. A pair of the least similarity shares no band with a chance of
#: (1 - 0.8^5)^30, less than 7 in 10^6; one of a similarity of 0.1 shares any with 3 in 10,000.
BANDS, VALUES = 30, 5
#: Members of a bucket that are paired at once.
FEW = 8
#: A block holds so many shingles, where a member counts as LIGHT of them at least: 1,024 members at most.
BLOCK, LIGHT = 1 << 18, 1 << 8
MULTIPLY, ADD = (np.random.default_rng(42).integers(0, 2**32, BANDS * VALUES, np.uint32) | np.uint32(x) for x in (1, 0))


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles in order; a text of fewer words is one shingle, and one without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles: Iterator[bytes] = iter([b" ".join(tokens)]) if len(tokens) <= words else map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(tokens) - words + 1))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, of the least values that its permutations give to any of the shingles."""
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * VALUES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        least = np.minimum(least, (low[i : i + 512, None] * MULTIPLY + ADD).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, VALUES).T:
        keys = mix64(keys ^ column.astype(np.uint64)) + np.uint64(1)
    return keys


def similar(both: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of na and nb shingles, of which both have ``both``, have the least similarity or more."""
    return sum(SIMILAR) * both >= SIMILAR[0] * (na + nb)


MEMBERS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("block", pa.int64())])


def bucket_members(nodes: DataFrame) -> DataFrame:
    """From nodes (id, n, keys): pairs (a, b) of small buckets, and members (a, key, block) of large ones.

    A bucket is read as a stream: of a large one, a task holds no more than a batch.
    """
    names = ["key", "id", "n"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            which = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(which) for c in names[1:])], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, going, weight = None, None, 0
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            parts = [x for x in (rest, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            table = pa.Table.from_batches(parts).combine_chunks()
            keys, n, ids = table["key"].to_numpy(), table["n"].to_numpy(), table["id"].combine_chunks()
            starts, ends = runs(keys)
            large = (ends - starts > FEW) | ((keys[starts] == going) if going is not None else False)
            rest = None
            if batch is not None and not large[-1]:
                rest = table.slice(int(starts[-1])).combine_chunks().to_batches()[0]
                starts, ends, large = starts[:-1], ends[:-1], large[:-1]
            few = np.zeros(len(keys), bool)
            few[: int(ends[-1]) if len(ends) else 0] = np.repeat(~large, ends - starts)
            for d in range(1, FEW):
                i = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
                i = i[similar(np.minimum(n[i], n[i + d]), n[i], n[i + d])]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(i + d)), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], schema=MEMBERS)
            for s, e in zip(starts[large], ends[large]):
                weight = 0 if keys[s] != going else weight
                total = weight + np.cumsum(np.maximum(n[s:e], LIGHT))
                going, weight = keys[s], int(total[-1])
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.nulls(e - s, pa.binary()), pa.array(keys[s:e]), pa.array((total - 1) // BLOCK)], schema=MEMBERS)

    rows = nodes.select("id", "n", "keys").mapInArrow(lean(spread), "key long, id binary, n long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(deal), "a binary, b binary, key long, block long")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the sets of the nodes (id, k1, k2), made from the texts of the rows that k1 and k2 name."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", SHINGLE, 42)).tobytes() for t in column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.select("k1", "k2", "text").join(ids, ["k1", "k2"]).select("id", "text")
    return kept(texts.mapInArrow(lean(make), "id binary, shingles binary").dropDuplicates(["id"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                hit.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(check), "a binary, b binary")


def forest(sets: list[np.ndarray], label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (i, j) that connect what similar sets connect, beside those that already have one label."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.flatnonzero(count > 1)
    at = np.full(len(count), -1)
    at[shared] = np.arange(len(shared))
    column = at[column]
    owner, column = owner[column >= 0], column[column >= 0]
    common = np.bincount(owner, minlength=m)
    has = np.zeros((len(shared), -(-m // 8)), np.uint8)
    np.bitwise_or.at(has, (column, owner >> 3), (np.uint8(128) >> (owner & 7).astype(np.uint8)))
    ends = np.cumsum(common)
    able = SIMILAR[1] * common >= SIMILAR[0] * size
    label = label.copy()
    found: tuple[list[int], list[int]] = ([], [])
    for i in np.flatnonzero(able).tolist():
        open_ = able & (label != label[i])
        open_[: i + 1] = False
        if not open_.any():
            continue
        both = np.unpackbits(has[column[ends[i] - common[i] : ends[i]]], axis=1, count=m).sum(axis=0, dtype=np.int64)
        hit = np.flatnonzero(open_ & similar(both, size, size[i]))
        if len(hit):
            labels, first = np.unique(label[hit], return_index=True)
            found[0].extend([i] * len(first))
            found[1].extend(hit[first].tolist())
            label[np.isin(label, labels)] = label[i]
    return found


def tile_links(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for rows (tile, id, root), links that connect what similar sets of a tile connect beside equal roots."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "tile", 2048):
            keys, ids, roots = table["tile"].to_numpy(), table["id"].combine_chunks(), table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            shingles = table["shingles"].combine_chunks()
            for s, e in zip(*runs(keys)):
                a, b = forest([np.frombuffer(shingles[k].as_buffer(), np.uint64) for k in range(s, e)], roots[s:e])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(x, np.int64) + s)) for x in (a, b)], names=["a", "b"])

    rows = tiles.join(sets, "id").select("tile", "id", "root", "shingles")
    return kept(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(compare), "a binary, b binary"))


def large_bucket_links(members: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links that, with the known ones, connect what similar sets in large buckets (id, key, block) connect."""
    last = members.groupBy("key").agg(F.max("block").alias("last"))
    blocks = kept(members.join(last, "key"))
    to = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.least(F.lit(1).cast("long"), "last"), "last"))
    first = blocks.select("id", F.col("id").alias("root"), "key", F.explode(to).alias("to"))
    links = known.union(tile_links(first.select(F.xxhash64("key", "to").alias("tile"), "id", "root"), sets))
    many = blocks.filter("last > 1").drop("last")
    if not many.take(1):
        return links
    many = kept(many.join(components(links, "a", "b"), F.col("id") == F.col("node"), "left").select("id", "key", "block", F.coalesce("root", "id").alias("root")))
    most = many.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("all"))
    split = most.select("key", F.col("most.root").alias("core"), (F.col("all") - F.col("most.count")).alias("fringe")).filter("fringe > 0")
    core = many.join(split, ["key"]).withColumn("parts", F.ceil(F.col("fringe") * LIGHT / BLOCK)).withColumn("in_core", F.col("root") == F.col("core"))
    inner = core.groupBy("key").agg(F.max(F.when(F.col("in_core"), F.col("block"))).alias("inner"))
    core = core.join(inner, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    edge = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    within = F.transform(edge, lambda p: F.struct(F.lit("f").alias("kind"), F.least(p, F.col("part")).alias("x"), F.greatest(p, F.col("part")).alias("y")))
    across = F.when(F.col("inner").isNull(), F.array().cast("array<struct<kind:string,x:bigint,y:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), "inner"), lambda b: F.struct(F.lit("c").alias("kind"), F.col("part").alias("x"), b.alias("y"))))
    to = F.when(F.col("in_core"), F.transform(edge, lambda p: F.struct(F.lit("c").alias("kind"), p.alias("x"), F.col("block").alias("y")))).otherwise(F.concat(within, across))
    tiles = core.select("key", "id", "root", F.explode(to).alias("to")).select(F.xxhash64("key", "to.kind", "to.x", "to.y").alias("tile"), "id", "root")
    return links.union(tile_links(tiles, sets))
