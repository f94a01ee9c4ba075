"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints are 64 majority bits of the XXH64 hashes of word shingles. The search groups correlated
bits, cuts them into segments and gives each segment its own threshold, by dynamic programming on
estimated candidate counts, so that two fingerprints within ``distance`` must agree to within its
threshold on at least one segment. Segments are probed by hashed keys and every candidate is verified.

Edge cases: a null or empty text, or one without words, has fingerprint zero and links like any other;
equal fingerprints are one node, so copies never form pairs; a null doc_id keeps its row and takes the
smallest doc_id of its component; repeated rows are repeated in the result; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Forest, by_key, column_bytes, components, documents, kept, lean, map_rows, mix64, parts_for, runs, texts
from .shingles import SHINGLE, band_keys, bucket_members, large_bucket_links, shingle_hashes, shingle_sets, verified

BITS = 64
#: Rows of a bucket that are compared pair by pair; larger buckets are linked by wildcard keys.
PAIRWISE = 40_000
#: Pairs that are compared in the time that one probe key takes.
PROBE = 300
#: The most probe keys of a fingerprint, which bounds what is shuffled.
KEYS = 80


def majority_bits(hashes: np.ndarray) -> int:
    """The word of bits that over half the hashes have."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def step(batch: pa.RecordBatch) -> dict:
        fps = np.array([majority_bits(shingle_hashes(t, words, seed)) for t in column_bytes(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return map_rows(texts(docs), step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each two bits are set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                fps = batch.column("fp").slice(i, 1 << 14).to_numpy()
                bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.r_[both.ravel(), n])], names=["k", "v"])

    rows = dict(nodes.select("fp").mapInArrow(lean(run), "k long, v long").groupBy("k").agg(F.sum("v")).collect())
    counts = np.array([rows.get(i, 0) for i in range(BITS * BITS + 1)], np.float64)
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def correlated_order(n: int, both: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bits in an order that puts correlated ones side by side, and their correlations."""
    p = np.diag(both) / max(n, 1)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(scale, scale))
    np.fill_diagonal(phi, 0)
    order = [int(np.argmax(phi.sum(axis=0)))]
    while len(order) < BITS:
        near = phi[order[-8:]].sum(axis=0)
        near[order] = -1
        order.append(int(np.argmax(near)))
    return order, phi


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Segments (bits, threshold) of least estimated cost that miss no pair within ``distance``.

    The thresholds t satisfy sum(t + 1) = distance + 1. A segment costs its probe keys and the pairs
    that are expected to agree on it to within t, from each bit's share of ones over all fingerprints;
    correlated bits count as fewer. A probe is shuffled and sorted, so it costs as much as PROBE pairs.
    """
    price = PROBE
    while True:
        found = cheapest(n, both, distance, price)
        if sum(math.comb(len(bits), t) for bits, t in found) <= KEYS:
            return found
        price *= 4


def cheapest(n: int, both: np.ndarray, distance: int, price: float) -> list[tuple[list[int], int]]:
    order, phi = correlated_order(n, both)
    p = np.diag(both)[order] / max(n, 1)
    differ = 2 * p * (1 - p)
    phi = phi[np.ix_(order, order)]
    budget = distance + 1
    best = {(0, 0): (0.0, [])}
    cost = np.full((BITS + 1, BITS + 1, budget), math.inf)
    for i in range(BITS):
        mass = np.zeros(budget)
        mass[0] = 1
        related = 0.0
        for j in range(i, BITS):
            mass = mass * (1 - differ[j]) + np.r_[0, mass[:-1]] * differ[j]
            related += 2 * (phi[i:j, j] ** 2).sum()
            length = j - i + 1
            fewer = length / (length + related)
            for t in range(min(budget, length)):
                probes = math.comb(length, t)
                pairs = n * n / 2 * min(1.0, mass[: t + 1].sum()) ** fewer
                cost[i, j + 1, t] = pairs + price * n * probes
    for end in range(1, BITS + 1):
        for spent in range(1, budget + 1):
            found = min(((best[i, spent - t - 1][0] + cost[i, end, t], i, t) for t in range(spent) for i in range(end) if (i, spent - t - 1) in best), default=None)
            if found and math.isfinite(found[0]):
                c, i, t = found
                best[end, spent] = (c, [*best[i, spent - t - 1][1], (sorted(order[i:end]), t)])
    return best[BITS, budget][1]


def probe_keys(fps: np.ndarray, segments: list[tuple[list[int], int]]) -> np.ndarray:
    """A key for each fingerprint and each way to blank t bits of a segment; within t bits, one is shared."""
    out = []
    for bits, t in segments:
        whole = sum(1 << b for b in bits)
        for k, blank in enumerate(combinations(bits, t)):
            mask = whole - sum(1 << b for b in blank)
            tag = mix64(np.array([(mask ^ (k << 1)) & (2**64 - 1)], np.uint64))
            out.append(mix64((fps & np.uint64(mask)) ^ tag))
    return np.array(out)


def bucket_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect exactly what links connect in one bucket, one fewer than its rows at most."""
    n = len(fps)
    forest = Forest(n)
    if n <= PAIRWISE:
        rows = max(1, min(512, (1 << 22) // n))
        for i in range(0, n, rows):
            a, b = np.nonzero(np.bitwise_count(fps[i : i + rows, None] ^ fps[None, i:]) <= distance)
            forest.join(a + i, b + i)
    else:
        vary = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [b for b in range(BITS) if int(vary) >> b & 1]
        for blank in combinations(bits, min(distance, len(bits))):
            masked = fps & np.uint64((2**64 - 1) ^ sum(1 << b for b in blank))
            order = np.argsort(masked, kind="stable")
            same = masked[order[1:]] == masked[order[:-1]]
            forest.join(order[1:][same], order[:-1][same])
    far = np.flatnonzero(forest.parent != np.arange(n))
    return far, forest.parent[far]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): verified pairs of fingerprints (fp) whose components are those of all links within ``distance`` bits."""
    spark = nodes.sparkSession
    n, both = bit_statistics(nodes)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    segments = plan(n, both, distance)
    probes = sum(math.comb(len(bits), t) for bits, t in segments)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 15):
                part = batch.column("fp").slice(i, 1 << 15)
                for keys in probe_keys(part.to_numpy().view(np.uint64), segments):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "key"):
            keys, fps = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            starts, ends = runs(keys)
            size = ends - starts
            found = []
            small = np.repeat(size <= 16, size)
            for d in range(1, int(min(16, size.max(initial=0)))):
                i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:] & (fps[d:] != fps[:-d]))
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= distance]
                found.append((i, i + d))
            for s in np.flatnonzero(size > 16):
                a, b = bucket_links(fps[starts[s] : ends[s]], distance)
                found.append((a + starts[s], b + starts[s]))
            if found:
                a, b = (fps[np.concatenate(x)].view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = nodes.select("fp").mapInArrow(lean(probe), "key long, fp long")
    parts = parts_for(spark, n * probes, 2_000_000)
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(verify), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that links of ``distance`` bits or fewer reach."""
    found = kept(fingerprints(docs, words, seed))
    nodes = kept(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes, distance), "a", "b")
    rooted = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: Differing bits at which the stage's search by fingerprints takes a pair as a candidate.
STAGE_DISTANCE = 3


def signed(docs: DataFrame) -> DataFrame:
    """k1 and k2 (a hash of the whole row), doc_id, ``id`` (equal for equal sets of shingles), ``n`` (of them), ``fp`` and the bands' ``keys``."""

    def step(batch: pa.RecordBatch) -> dict:
        ids, sizes, fps, keys = [], [], [], []
        for text in column_bytes(batch.column("text")):
            hashes = shingle_hashes(text or b"", SHINGLE, 42)
            found = np.unique(hashes)
            ids.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            fps.append(majority_bits(hashes))
            keys.append(band_keys(found).tobytes())
        return {c: batch.column(c) for c in ("k1", "k2", "doc_id")} | {"id": ids, "n": sizes, "fp": np.array(fps, np.uint64).view(np.int64), "keys": keys}

    return map_rows(docs.select("k1", "k2", "doc_id", "text"), step, f"k1 long, k2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, id binary, n long, fp long, keys binary")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes (id, fp) of one fingerprint or of linked ones, each with one other of its group."""
    groups = kept(nodes.groupBy("fp").agg(F.min("id").alias("least")))
    same = nodes.join(groups, "fp").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    side = lambda c: groups.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}"))
    near = links(groups, STAGE_DISTANCE).distinct().join(side("a"), "a").join(side("b"), "b").select("id_a", "id_b")
    return same.union(near)


def similar_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the components that similar sets of shingles form, for every node that has a link."""
    found = kept(bucket_members(nodes))
    pairs = kept(found.filter("key IS NULL").select("a", "b").union(fingerprint_pairs(nodes)))
    members = found.filter("key IS NOT NULL").select(F.col("a").alias("id"), "key", "block")
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct()
    sets = shingle_sets(docs, nodes.join(used, "id").select("id", "k1", "k2"))
    known = kept(verified(pairs, sets))
    return components(kept(large_bucket_links(members, sets, known)), "a", "b")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates by five-word shingles: the one with the smallest doc_id.

    Near-duplicates are texts whose sets of shingles have a Jaccard similarity of 0.8 or more, and what a
    chain of them connects. The search by fingerprints gives the candidates of few differing bits, MinHash
    bands those that fingerprints can't tell from others, and each is decided by its sets.
    Groups are of rows, not of doc_ids: rows that share a doc_id or have none stay if their texts are unlike.
    A row without a doc_id stays if none with one is like it; of rows that agree in doc_id, one stays by its
    hash, and of rows that agree in all columns one stays. Null and empty texts and texts without a word have
    the empty set and are one group; an empty table gives none; other columns than those of documents go.
    """
    whole = [*DOCUMENT_COLUMNS, *(F.col(c).isNull() for c in DOCUMENT_COLUMNS)]
    docs = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(F.lit(1), *whole).alias("k1"), F.xxhash64(F.lit(2), *whole).alias("k2"))
    rows = kept(signed(docs))
    once = rows.groupBy("id", "k1", "k2", "doc_id").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.count("*").alias("copies"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "copies")
    ranked = once.groupBy("id").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    keys = rows.groupBy("id").agg(F.min("keys").alias("keys"))
    nodes = kept(ranked.join(keys, "id").select("id", "n", "fp", "keys", "rank.k1", "rank.k2", "rank"))
    joined = similar_components(docs, nodes)
    rooted = nodes.select("id", "rank").join(joined, F.col("id") == joined.node, "left")
    keep = rooted.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("rank").alias("rank")).select("rank.k1", "rank.k2", "rank.copies")
    left = docs.join(keep, ["k1", "k2"])
    return left.filter("copies = 1").union(left.filter("copies > 1").dropDuplicates(["k1", "k2"])).select(*DOCUMENT_COLUMNS)
