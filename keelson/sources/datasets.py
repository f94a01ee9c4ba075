"""Stored datasets: upserts that rewrite only the buckets they touch, contracts in every file's footer, and digests as trees.

A dataset has its rows in buckets by a hash of their key, each bucket in the folder of the version that
wrote it last, and a log of numbered manifests that say which version that is. A new version is written
beside the old ones; creating the next manifest makes it the dataset's, all at once, and fails if another
writer came first. Whatever stops a writer before that leaves the dataset as it was.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import content_hash
from ..operators.lineage import stored
from . import files
from .files import ConflictError, canonical_json

BUCKETS = 16


def unbroadcast(rows: DataFrame) -> DataFrame:
    """Rows that no join broadcasts: files of sorted keys are small for what they hold, and Spark goes by the files."""
    return rows.hint("merge")


def fresh_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One incoming row of each key that is not there yet."""
    return incoming.dropDuplicates([key]).join(unbroadcast(existing.select(key)), key, "left_anti").select(*incoming.columns)


def classify(existing: DataFrame, incoming: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, action): insert, no_op or conflict for each distinct incoming record."""
    old = existing.select(F.col(key).alias("its_key"), payload.alias("old"))
    new = incoming.select(key, payload.alias("new")).distinct()
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    joined = new.withColumn("alone", alone).join(unbroadcast(old), F.col(key) == F.col("its_key"), "left")
    action = F.when(~F.col("alone"), "conflict").when(F.col("its_key").isNull(), "insert").when(F.col("new") == F.col("old"), "no_op").otherwise("conflict")
    return joined.select(key, action.alias("action"))


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and the body of the newest manifest: how many buckets there are, and the version of each that has rows."""
    numbers = [int(n[:-5]) for n in files.listed(spark, f"{path}/log") if re.fullmatch(r"[0-9]+\.json", n)]
    if not numbers:
        return 0, {"buckets": 0, "versions": {}}
    return max(numbers), json.loads(files.read(spark, f"{path}/log/{max(numbers):012}.json"))


def read_dataset(spark: SparkSession, path: str, schema: StructType | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The rows, or those of some buckets; None if there are none and no schema is given."""
    _, body = manifest(spark, path)
    paths = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(body["versions"].items()) if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], schema) if schema else None
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: str, payload: Column, contract: dict | None = None, buckets: int = BUCKETS, at_hand: bool = False) -> bool:
    """Adds new records; True if anything was written. Records are read three times, so they are stored first, unless they are ``at_hand``.

    Equal records are no change; a conflict raises before anything is written. Only buckets that an
    incoming record falls into are read, and only those that get a new one are rewritten, sorted by key.
    ``buckets`` counts for a dataset that is not there yet.
    """
    incoming = incoming if at_hand else stored(incoming)
    number, body = manifest(spark, path)
    buckets = body["buckets"] or buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = {r[0] for r in incoming.select(bucket).distinct().collect()}  # as many as there are buckets, at most
    existing = read_dataset(spark, path, incoming.schema, touched)
    actions = classify(existing, incoming, key, payload)
    found = {(r["action"], r["bucket"]): r["n"] for r in actions.groupBy("action", bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}
    conflicts = sum(n for (action, _), n in found.items() if action == "conflict")
    if conflicts:
        raise ConflictError(f"{conflicts} records of {path} conflict")
    changed = {b for action, b in found if action == "insert"}
    if not changed:
        return False
    rows = read_dataset(spark, path, incoming.schema, changed).unionByName(fresh_rows(existing, incoming, key)).withColumn("bucket", bucket)
    if contract:
        rows = rows.withMetadata(key, {"contract": contract})
    version = uuid.uuid4().hex
    rows.repartition(len(changed), "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/data/{version}")
    following = {"buckets": buckets, "versions": body["versions"] | {str(b): version for b in sorted(changed)}}
    files.write_once(spark, f"{path}/log/{number + 1:012}.json", canonical_json(following))
    return True


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes what the newest manifest doesn't name: buckets written again since, and what stopped writers left; their folders. No reader or writer may be at work."""
    held = {f"{v}/bucket={b}" for b, v in manifest(spark, path)[1]["versions"].items()}
    there = {"/".join(n.split("/")[:2]) if "/bucket=" in n else n.split("/")[0] for n in files.listed(spark, f"{path}/data")}
    versions = {h.split("/")[0] for h in held}
    gone = sorted(t for t in there - held if "/" in t or t not in versions)
    for folder in gone:
        files.remove(spark, f"{path}/data/{folder}")
    return gone


FOOTER = "path string, rows long, contract string"


def footers(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """What the footer of every part file states as its contract, in the metadata of the key's field; read where the tasks are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with store.open_input_file(at) as source:
                    footer = pq.read_metadata(source)
                stated = json.loads((footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata") or b'{"fields": []}')
                contract = next((f["metadata"].get("contract") for f in stated["fields"] if f["name"] == key), None)
                found.append({"path": path, "rows": footer.num_rows, "contract": contract and json.dumps(contract, sort_keys=True)})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("path", pa.string()), ("rows", pa.int64()), ("contract", pa.string())]))

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path")
    return listed.mapInArrow(run, FOOTER)


def check_footers(spark: SparkSession, path: str, key: str, contract: dict) -> None:
    """Raises with the names of part files whose footer states another contract, or none."""
    _, body = manifest(spark, path)
    paths = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(body["versions"].items())]
    stated = json.dumps(contract, sort_keys=True)
    bad = footers(spark, paths, key).filter(~F.col("contract").eqNullSafe(F.lit(stated))).take(5) if paths else []
    if bad:
        held = [json.loads(r["contract"] or "{}") for r in bad]
        raise ConflictError("; ".join(f"{r['path']}: contract differs in {', '.join(k for k, v in contract.items() if h.get(k) != v)}" for r, h in zip(bad, held)))


#: Hexadecimal digits that one level of a digest's tree stands for (16 children to a node), and rows to a leaf.
FAN_OUT, LEAF = 16, 256


def digest_tree(rows: DataFrame, keys: list[str], depth: int, row: Column | None = None, key: Column | None = None) -> DataFrame:
    """(level, prefix, rows, digest): SHA-256 over canonical rows, folded as a tree of 16 children to a node.

    A row lies in the leaf that the first digits of its key's hash name, whatever file or partition has it.
    A leaf's digest is that of its rows' hashes in order, repeats included; a node's is that of its
    children's names and digests. Level 0 is the root, whose prefix is empty.
    """
    prefix = F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)), 256) if key is None else F.sha2(key, 256), 1, depth)
    hashed = rows.select(prefix.alias("prefix"), (content_hash(*rows.columns) if row is None else F.sha2(row, 256)).alias("hash"))
    level = hashed.groupBy("prefix").agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("hash"))), 256).alias("digest"))
    out = level.select(F.lit(depth).alias("level"), "prefix", "rows", "digest")
    for n in range(depth - 1, -1, -1):
        child = F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest")))
        level = level.groupBy(F.substring("prefix", 1, n).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sha2(F.concat_ws(",", child), 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(n).alias("level"), "prefix", "rows", "digest"))
    return out


def depth_for(n: int, leaf: int = LEAF) -> int:
    """Levels below the root so that a leaf has some ``leaf`` rows."""
    return max(1, math.ceil(math.log(max(n, 1) / leaf, FAN_OUT))) if n > leaf else 1


def tree_differences(stated: DataFrame, found: DataFrame) -> DataFrame:
    """(level, prefix, stated_rows, found_rows) of the nodes whose digests differ, from the root down to the leaves."""
    a = stated.select("level", "prefix", F.col("rows").alias("stated_rows"), F.col("digest").alias("stated"))
    b = found.select("level", "prefix", F.col("rows").alias("found_rows"), F.col("digest").alias("found"))
    both = a.join(b, ["level", "prefix"], "full_outer").filter(~F.col("stated").eqNullSafe(F.col("found")))
    return both.select("level", "prefix", F.coalesce("stated_rows", F.lit(0)).alias("stated_rows"), F.coalesce("found_rows", F.lit(0)).alias("found_rows"))
