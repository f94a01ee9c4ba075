"""Reports regenerated from captures: partial aggregates are kept by the digest of what they were derived from.

A run derives only captures whose digest it has not met, adds their partials to a dataset (all at once, see
``datasets``), and sums up the partials of the captures that are there now. So a full run and any sequence
of incremental ones give the same report; a capture whose name now leads to other bytes counts by those,
and an object whose bytes were changed in place is found by its digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import stored
from . import datasets
from .captures import captured, fetch, object_path
from .files import ConflictError

PARTIAL = "id string, digest string, key string, n long, total decimal(38,0)"
INPUT = "id string, name string, digest string"
#: Captures to a task that derives from them.
DERIVED = 64


def contents(digests: DataFrame, root: str) -> DataFrame:
    """(digest, content) of captured objects, read by the tasks that hold the digests; one that is not what its name says raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(root)
        for batch in batches:
            for digest in batch.column("digest").to_pylist():
                content = fetch(store, f"{at}/{object_path(digest)}")
                if sha256(content).hexdigest() != digest:
                    raise ConflictError(f"object {digest} is not what its name says")
                yield pa.RecordBatch.from_pylist([{"digest": digest, "content": content}], schema=pa.schema([("digest", pa.string()), ("content", pa.binary())]))

    return digests.select("digest").mapInArrow(run, "digest string, content binary")


@dataclass(frozen=True)
class Run:
    """A run's report, (key, n, total); how many captures it derived, and the names that lead to other bytes than in any run before."""

    report: DataFrame
    derived: int
    changed: DataFrame


def regenerate(spark: SparkSession, root: str, target: str, derive: Callable[[DataFrame], DataFrame], collection: str | None = None) -> Run:
    """Brings the partials below ``target`` up to the captures below ``root`` and reports their sums.

    ``derive`` takes (digest, content) and gives (digest, key, n, total), additive in n and total; a capture
    from which nothing follows is remembered by a row without a key. The key is of text, or null.
    """
    found = captured(spark, root)
    found = (found.filter(F.col("collection") == collection) if collection else found).select(F.concat_ws("/", "collection", "name").alias("name"), F.col("content_sha256").alias("digest")).distinct()
    partials, inputs = datasets.read_dataset(spark, f"{target}/partials", StructType.fromDDL(PARTIAL)), datasets.read_dataset(spark, f"{target}/inputs", StructType.fromDDL(INPUT))
    before = inputs.groupBy("name").agg(F.collect_set("digest").alias("seen"))
    changed = found.join(before, "name").filter(~F.array_contains("seen", F.col("digest"))).select("name", "digest", "seen")
    changed = stored(changed)  # as it is now: the inputs of this run are added below
    fresh = found.select("digest").distinct().join(datasets.unbroadcast(partials.select("digest").distinct()), "digest", "left_anti")
    fresh = stored(fresh)
    derived = fresh.count()
    if derived:
        # digests are short, their contents aren't: by the digests' bytes, one task would have them all
        rows = derive(contents(fresh.repartition(max(1, -(-derived // DERIVED))), root)).groupBy("digest", "key").agg(F.sum("n").cast("long").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        marks = fresh.select("digest", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total"))
        named = F.concat_ws("/", "digest", F.coalesce(F.sha2("key", 256), F.lit("")))
        whole = rows.unionByName(marks).groupBy("digest", "key").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        datasets.upsert(spark, f"{target}/partials", whole.select(named.alias("id"), "digest", "key", "n", "total"), "id", F.to_json(F.struct("key", "n", "total")))
    datasets.upsert(spark, f"{target}/inputs", found.select(F.sha2(F.concat_ws("/", "name", "digest"), 256).alias("id"), "name", "digest"), "id", F.to_json(F.struct("name", "digest")))
    held = datasets.read_dataset(spark, f"{target}/partials", StructType.fromDDL(PARTIAL))
    # a digest counts as often as names lead to it
    report = held.join(found.groupBy("digest").agg(F.count("*").alias("times")), "digest").groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("total") * F.col("times")).cast("decimal(38,0)").alias("total")).filter("key IS NOT NULL OR n <> 0")
    return Run(report, derived, changed)


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """(digest) of captured objects that are gone or whose bytes are no longer those of their name; all are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths = {d: f"{at}/{object_path(d)}" for d in batch.column("digest").to_pylist()}
            bad = [d for d, p in paths.items() if store.get_file_info(p).type == fs.FileType.NotFound or sha256(fetch(store, p)).hexdigest() != d]
            yield pa.RecordBatch.from_pydict({"digest": pa.array(bad, pa.string())})

    return captured(spark, root).select(F.col("content_sha256").alias("digest")).distinct().mapInArrow(run, "digest string")
