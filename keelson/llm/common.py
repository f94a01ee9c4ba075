"""What the text operators share: reading, shared storage, packed exchanges and connected components."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: The columns of ``documents``, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without their lineage: they survive the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner delete the shuffle files of plans that nothing refers to any more, before more are written.

    Collects until the number of shuffles that the driver knows falls no further: plans stay referenced for
    a while after they ran, by events that are still to be handled.
    """
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    last, same = known.size(), 0
    for _ in range(10):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
        now = known.size()
        last, same = now, same + 1 if now == last else 0
        if same == 3:
            break


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that gives back, after each task, the memory that the task no longer uses.

    Workers serve one stage after another, and allocators keep what was freed; so peaks would add up.
    """

    def wrapped(rows: Iterator) -> Iterator:
        try:
            yield from run(rows)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``place``, from 0 in an order without ties: ranked within ranges, each range after those before it."""
    dealt = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.count("*")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    start = F.create_map(*(F.lit(x) for pair in zip([p for p, _ in sizes] or [0], before) for x in pair))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", F.element_at(start, F.col("part")) + rank).drop("part")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and the text, where a null text is an empty one."""
    return docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))


def map_rows(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """Runs ``step`` on each Arrow batch; it returns columns by name. ``start`` makes what a task needs once."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start() if start else None
        for batch in batches:
            columns = step(batch, held) if start else step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(lean(run), schema)


def column_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that are read, from the optimised plan's statistics, without a job; of the texts themselves where the plan can't say."""
    stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stated if stated < 1 << 60 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """How many parts of ``each`` make up ``amount``; at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Forest:
    """Union by smallest index over numpy arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(q := p[p], p):
                p = q
        self.parent = p


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return starts, np.r_[starts[1:], len(keys)] if len(keys) else starts


def by_key(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole key groups, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        starts, _ = runs(keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            count = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that edges lead to, for every node of an edge between different nodes.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the
    logarithm of the longest path; each round's edges go to the shared folder. A hub's edges are
    combined before they are shuffled, and the joins are left to adaptive execution to split.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pair = kept(pair)
    before = None
    while True:
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pair = kept(small)
        now = tuple(pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pair.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pair.select("v", "v").distinct())
        before = now
