"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared within a label only. Equal vectors are one row of the comparison, with their number.
Unit vectors are turned to their principal axes; a cell is a box as wide as two linked vectors can be
apart on the leading axes, so a vector meets only its own cell and the neighbouring ones; each label is cut
on as many axes as pay for it. Large cells are cut into tiles, which are stored once and read by the tasks
that compare them, a tile with a block of others at a time. There the leading dimensions' products come
first; what the rest could add is bounded by the product of the suffix norms, and pairs that cannot reach
the threshold stop. The others are computed in double precision on the vectors as given.

Edge cases: a null label, vec_id or vector, a zero vector and null or non-finite components link with
nothing; vectors of different lengths never link; rows that repeat are vectors of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship
from .common import Forest, by_key, components, kept, lean, parts_for, remove, runs, shared_dir

#: Vectors to a tile.
TILE = 2048
#: Leading dimensions that are accumulated before the bound is tested, again and again.
STEPS = (16, 32)
#: Axes that cells may be cut on.
AXES = 3
#: Pairs of vectors that are compared in the time that one tile is read, and tiles to a row of work.
READ, BLOCK = 100_000, 32


def unit(raw: np.ndarray) -> np.ndarray:
    whole = raw.astype(np.float64)
    whole /= np.abs(whole).max(axis=1, keepdims=True)
    return whole / np.sqrt(np.einsum("ij,ij->i", whole, whole))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def principal_axes(distinct: DataFrame, dimension: int) -> np.ndarray:
    """Columns are the axes, by falling variance, of all unit vectors; only d x d sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column("embedding"), dimension))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension * dimension)), pa.array(total.ravel())], names=["k", "v"])

    sums = dict(distinct.select("embedding").mapInArrow(lean(run), "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    moments = np.array([sums[k] for k in range(dimension * dimension)]).reshape(dimension, dimension)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; i < j only where both sides are the ``same`` rows."""
    ua, ub = unit(a), unit(b)
    ta, tb = ua @ axes, ub @ axes
    cuts = [0, *(s for s in STEPS if s < ta.shape[1]), ta.shape[1]]
    left = [np.sqrt(np.maximum(0, (ta[:, c:] ** 2).sum(axis=1))) for c in cuts]
    right = [np.sqrt(np.maximum(0, (tb[:, c:] ** 2).sum(axis=1))) for c in cuts]
    found = []
    for i in range(0, len(ta), 512):
        rows = slice(i, i + 512)
        near = ta[rows, : cuts[1]] @ tb[:, : cuts[1]].T
        x, y = np.nonzero(near + np.outer(left[1][rows], right[1]) >= threshold - 1e-9)
        reached = near[x, y]
        x += i
        if same:
            reached, x, y = reached[x < y], x[x < y], y[x < y]
        for k in range(1, len(cuts) - 1):
            part = slice(cuts[k], cuts[k + 1])
            reached = reached + np.concatenate([np.einsum("ij,ij->i", ta[x[j : j + 65536], part], tb[y[j : j + 65536], part]) for j in range(0, len(x), 65536)] or [reached])
            stays = reached + left[k + 1][x] * right[k + 1][y] >= threshold - 1e-9
            reached, x, y = reached[stays], x[stays], y[stays]
        exact = np.concatenate([np.einsum("ij,ij->i", ua[x[j : j + 65536]], ub[y[j : j + 65536]]) for j in range(0, len(x), 65536)] or [reached])
        found.append((x[exact >= threshold], y[exact >= threshold]))
    x, y = (np.concatenate(z) for z in zip(*found))
    return x, y


def axes_by_label(placed: DataFrame, tile: int, read: int) -> DataFrame:
    """(label, used): on how many axes a label's cells are cut, by pairs to compare and tiles to read; a label of one tile is not cut."""
    at = [f"c{i}" for i in range(AXES)]
    finest = kept(placed.groupBy("label", *at).agg(F.count("*").alias("n")))
    costs = None
    for g in range(AXES + 1):
        cells = finest.groupBy("label", *at[:g]).agg(F.sum("n").cast("double").alias("n"))
        sums = cells.groupBy("label").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.count("*").alias("cells"), F.sum(F.ceil(F.col("n") / tile)).alias("tiles"))
        reads = F.when(F.col("tiles") == 1, 0).otherwise(F.col("tiles") * read)
        cost = sums.select("label", F.lit(g).alias("used"), ((F.col("pairs") + reads) * (3**g / 2)).alias("cost"))
        costs = cost if costs is None else costs.union(cost)
    return costs.groupBy("label").agg(F.min(F.struct("cost", "used"))["used"].alias("used"))


def links_found(count: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Rows of tile_links: how many links each of ``ids`` has, and steps that connect what the pairs (x, y) connect."""
    forest = Forest(len(ids))
    forest.join(x, y)
    far, some = np.flatnonzero(forest.parent != np.arange(len(ids))), np.flatnonzero(count)
    b = pa.array(np.r_[np.zeros(len(some), np.int64), ids[forest.parent[far]]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(far), bool)])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[ids[some], ids[far]]), b, pa.array(np.r_[count[some].astype(np.int64), np.zeros(len(far), np.int64)])], names=["a", "b", "links"])


def tile_links(distinct: DataFrame, dimension: int, threshold: float, tile: int, read: int) -> DataFrame:
    """(a, b, links): the links of vector a that a pair of tiles holds, with b null; or a step of a path between a and b.

    A vector is shuffled once, to its tile. The task that gathers a tile compares it with itself and, unless
    its label has no other tile, stores it as a part of a file of its own in the shared folder. Pairs of
    tiles are then rows of places in those files, which tasks read; so copies of vectors are never shuffled
    or stored, however many tiles a vector meets. Only rows of tasks that ended well name their files.
    """
    spark = distinct.sparkSession
    axes = principal_axes(distinct, dimension)
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-6) if threshold < 1 else 1e-6
    many = min(AXES, dimension)
    kind = distinct.schema["embedding"].dataType.simpleString()
    label = distinct.schema["label"].dataType.simpleString()
    at = [f"c{i}" for i in range(AXES)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(unit(matrix(batch.column("embedding"), dimension)) @ axes[:, :many] / width).astype(np.int32)
                more = [pa.array(cells[:, i]) if i < many else pa.array(np.zeros(len(cells), np.int32)) for i in range(AXES)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *at])

    placed = kept(distinct.select("rep", "n", "label", "embedding").mapInArrow(lean(place), f"rep long, n long, label {label}, embedding {kind}, " + ", ".join(f"{c} int" for c in at)))
    used = axes_by_label(placed, tile, read)
    cut = placed.join(used, "label").select("rep", "n", "label", "embedding", *(F.when(F.col("used") > i, F.col(c)).otherwise(0).alias(c) for i, c in enumerate(at)))
    cells = kept(cut.groupBy("label", *at).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")))
    alone = cells.groupBy("label").agg((F.sum("tiles") == 1).alias("alone"))
    own = cut.join(cells.join(alone, "label"), ["label", *at]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles").cast("long")).cast("int"))
    # the names themselves are the key: two tiles under one hash would be taken for one
    own = own.withColumn("key", F.struct("label", *at, "tile").cast("string")).select("rep", "n", "embedding", "label", *at, "tile", "alone", "key")
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        try:
            for table in by_key(batches, "key", 4 * tile):
                for s, e in zip(*runs(table["key"].to_numpy())):
                    part = table.slice(s, e - s)
                    ids, n, raw = part["rep"].to_numpy(), part["n"].to_numpy(), matrix(part["embedding"], dimension)
                    x, y = linked_pairs(raw, raw, axes, threshold, True) if len(ids) > 1 else (np.zeros(0, int), np.zeros(0, int))
                    if len(x):
                        count = np.bincount(x, weights=n[y], minlength=len(ids)) + np.bincount(y, weights=n[x], minlength=len(ids))
                        found = links_found(count, ids, x, y)
                        no_tile = [pa.nulls(found.num_rows, f.type) for f in list(out)[:-3]]
                        yield pa.RecordBatch.from_arrays([*no_tile, *found.columns], schema=out)
                    if part["alone"][0].as_py():
                        continue
                    if sink is None:
                        store, root = fs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        name = uuid.uuid4().hex
                        sink = store.open_output_stream(f"{root}/{name}")
                    begin = sink.tell()
                    held = part.select(["rep", "n", "embedding"])
                    with pa.ipc.new_stream(sink, held.schema) as stream:
                        stream.write_table(held)
                    row = [*(part[c][0].as_py() for c in ("label", *at, "tile")), name, begin, sink.tell() - begin, None, None, None]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)
        finally:
            if sink is not None:
                sink.close()

    named = f"label {label}, " + ", ".join(f"{c} int" for c in at) + ", tile int, file string, begin long, size long, a long, b long, links long"
    out = to_arrow_schema(StructType.fromDDL(named))
    each = parts_for(spark, (cells.agg(F.sum("tiles")).first()[0] or 0) * tile * dimension * 4, 16 << 20)
    stored = kept(own.repartition(each, "key").sortWithinPartitions("key").mapInArrow(lean(gather), named))
    within = stored.filter("file is null").select("a", "b", "links")
    tiles = stored.filter("file is not null").select("label", *at, F.struct("tile", "file", "begin", "size").alias("here"))
    # of two cells that meet, the smaller one reaches the other
    forward = [step for step in product((-1, 0, 1), repeat=AXES) if step >= (0,) * AXES]
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(step)), F.lit(any(step)).alias("away")) for step in forward))
    reached = tiles.select("label", *at, "here", F.explode(steps).alias("step")).select("label", "here", F.col("step.away").alias("away"), *((F.col(c) + F.col(f"step.d{i}")).alias(c) for i, c in enumerate(at)))
    block = lambda c: F.floor(c / BLOCK).cast("int")
    first = F.when(F.col("away"), 0).otherwise(block(F.col("here.tile")))
    work = reached.join(cells, ["label", *at]).withColumn("block", F.explode(F.sequence(first, block(F.col("tiles") - 1))))
    blocks = tiles.groupBy("label", *at, block(F.col("here.tile")).alias("block")).agg(F.collect_list("here").alias("others"))
    work = work.join(blocks, ["label", *at, "block"]).select("here", "away", F.filter("others", lambda o: F.col("away") | (o["tile"] > F.col("here.tile"))).alias("others"))
    work = kept(work.filter(F.size("others") > 0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def load(where: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            with store.open_input_file(f"{root}/{where['file']}") as source:
                held = pa.ipc.open_stream(source.read_at(where["size"], where["begin"])).read_all()
            return held["rep"].to_numpy(), held["n"].to_numpy(), matrix(held["embedding"], dimension)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, raw = load(batch.column("here")[i].as_py())
                for other in batch.column("others")[i].as_py():
                    its_ids, its_n, its_raw = load(other)
                    x, y = linked_pairs(raw, its_raw, axes, threshold, False)
                    if len(x):
                        count = np.r_[np.bincount(x, weights=its_n[y], minlength=len(ids)), np.bincount(y, weights=n[x], minlength=len(its_ids))]
                        yield links_found(count, np.r_[ids, its_ids], x, y + len(ids))

    pairs = work.agg(F.sum(F.size("others"))).first()[0] or 0
    between = kept(work.repartition(parts_for(spark, pairs, 2 * BLOCK), "here").mapInArrow(lean(compare), "a long, b long, links long"))
    remove(spark, folder)
    return within.union(between)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, read: int = READ) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    sound = sound & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(sound, F.lit(False)).alias("sound"))
    distinct = kept(rows.filter("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    found = None
    for (dimension,) in distinct.select(F.size("embedding")).distinct().collect():
        part = tile_links(distinct.filter(F.size("embedding") == dimension), dimension, threshold, tile, read)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = kept(found)
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null"), "a", "b")
    named = distinct.join(counts, distinct.rep == counts.a, "left").join(joined, distinct.rep == joined.node, "left")
    named = named.select(F.col("label").alias("its_label"), F.col("embedding").alias("its_vector"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.lit(True).alias("its_sound"))
    out = rows.join(named, (rows.label == named.its_label) & (rows.embedding == named.its_vector) & (rows.sound == named.its_sound), "left")
    component = F.coalesce(F.when(F.col("sound"), F.col("component_id")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same links by all pairs of one label, for DuckDB.
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id))::BIGINT AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
