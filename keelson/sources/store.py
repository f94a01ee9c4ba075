"""What is stored: first-seen records, content-addressed captures, snapshots with digest trees and typed datasets."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators.lineage import stored
from ..records import DATASETS, VERSION, violations
from . import files
from .datasets import check_footers, classify, depth_for, digest_tree, read_dataset, tree_differences, upsert  # noqa: F401
from .files import ConflictError, canonical_json


def first_seen(rows: DataFrame, key: str, at: str, meaning: list[str]) -> DataFrame:
    """The first record of each key by time, with ``conflict``: records of the key differ in meaning."""
    w = Window.partitionBy(key)
    digest = F.xxhash64(*meaning)
    numbered = rows.withColumn("_place", F.row_number().over(w.orderBy(at, *meaning))).withColumn("conflict", F.min(digest).over(w) != F.max(digest).over(w))
    return numbered.filter("_place = 1").drop("_place")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, object_path) of the files below a folder: where each lies by its content."""
    digest = F.sha2("content", 256)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", digest.alias("sha256"), F.concat(F.lit("raw/objects/"), F.substring(digest, 1, 2), F.lit("/"), digest).alias("object_path"))


def manifest_cover(manifests: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with ``covered``: a manifest equals them on all keys, nulls included."""
    m = manifests.select(*(F.col(k).alias(f"m_{k}") for k in keys)).distinct().withColumn("there", F.lit(True))
    return observations.join(m, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys], "left").withColumn("covered", F.col("there").isNotNull()).drop("there", *(f"m_{k}" for k in keys))


def freeze(datasets: dict[str, DataFrame], target: str, namespace: uuid.UUID = uuid.NAMESPACE_OID, keys: dict[str, list[str]] | None = None) -> dict:
    """Writes datasets, the digest tree of each, and a manifest with their row counts and root digests; its id follows from the manifest.

    ``keys`` names the columns that place a dataset's rows in its tree; all columns, where it says nothing.
    """
    entries = []
    spark = next(iter(datasets.values())).sparkSession
    for name, df in sorted(datasets.items()):
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
        own = sorted((keys or {}).get(name, df.columns))
        depth = depth_for(spark.read.parquet(f"{target}/{name}").count())
        fingerprint(spark, f"{target}/{name}", own, depth).write.parquet(f"{target}/digests/{name}")
        entries.append(summary(spark, target, name, own, depth))
    body = {"entries": entries, "snapshot_id": str(uuid.UUID(int=0))}
    body["snapshot_id"] = str(uuid.uuid5(namespace, canonical_json(body).decode()))
    files.write_once(spark, f"{target}/manifest.json", canonical_json(body))
    return body


def fingerprint(spark: SparkSession, path: str, keys: list[str], depth: int) -> DataFrame:
    """The digest tree of what is stored at a path."""
    return digest_tree(spark.read.parquet(path), keys, depth)


def summary(spark: SparkSession, target: str, name: str, keys: list[str], depth: int) -> dict:
    """What a manifest states of a dataset, by the stored tree."""
    root = spark.read.parquet(f"{target}/digests/{name}").filter("level = 0").first()
    schema = hashlib.sha256(spark.read.parquet(f"{target}/{name}").schema.json().encode()).hexdigest()
    return {"name": name, "rows": root["rows"] if root else 0, "digest": root["digest"] if root else hashlib.sha256(b"").hexdigest(), "depth": depth, "keys": keys, "schema": schema}


def stated(spark: SparkSession, target: str, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> dict | None:
    """A snapshot's manifest, if its id follows from what it says."""
    body = json.loads(files.read(spark, f"{target}/manifest.json") or b"{}")
    if not body:
        return None
    own, body["snapshot_id"] = body["snapshot_id"], str(uuid.UUID(int=0))
    return body | {"snapshot_id": own} if own == str(uuid.uuid5(namespace, canonical_json(body).decode())) else None


def differences(spark: SparkSession, target: str) -> DataFrame:
    """(dataset, level, prefix, stated_rows, found_rows): where a snapshot's content is no longer that of its digest trees."""
    out = None
    for e in (stated(spark, target) or {"entries": []})["entries"]:
        found = fingerprint(spark, f"{target}/{e['name']}", e["keys"], e["depth"])
        part = tree_differences(spark.read.parquet(f"{target}/digests/{e['name']}"), found).withColumn("dataset", F.lit(e["name"]))
        out = part if out is None else out.union(part)
    return out


def verify(spark: SparkSession, target: str, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> bool:
    """Whether a frozen snapshot still has the id, the trees and the content that its manifest states."""
    body = stated(spark, target, namespace)
    same = body is not None and all(summary(spark, target, e["name"], e["keys"], e["depth"]) == e for e in body["entries"])
    return same and (not body["entries"] or differences(spark, target).isEmpty())


CAPTURE = "capture_id string, provider_namespace string, source_family string, content_sha256 string, length long, retrieved_at string, adapter_version string, parser_version string, retention_class string, license_name string, parameters string"


def capture(spark: SparkSession, root: str, content: bytes, **facts: str | None) -> dict:
    """Stores bytes once under their hash and adds a manifest, whose id follows from what it says; the manifest.

    The same bytes at another time are one object and two manifests. An object whose bytes are not those
    of its name raises, and so do facts with a credential's name.
    """
    digest = files.sha256(content)
    path = f"{root}/raw/objects/{digest[:2]}/{digest}"
    files.write_once(spark, path, content)
    if files.sha256(files.read(spark, path)) != digest:
        raise ConflictError(f"{path} is not what its name says")
    body = {c.split()[0]: None for c in CAPTURE.split(", ")} | {"content_sha256": digest, "length": len(content)} | facts
    if set(body) != {c.split()[0] for c in CAPTURE.split(", ")} or parse.names_secret(json.loads(body["parameters"] or "{}")):
        raise ValueError("unknown facts, or one that names a credential")
    body["capture_id"] = str(uuid.uuid5(uuid.NAMESPACE_OID, canonical_json(body).decode()))
    files.write_once(spark, f"{root}/raw/manifests/{body['capture_id']}.json", canonical_json(body))
    return body


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests below a root; one whose facts name a credential has ``secret``."""
    if not files.listed(spark, f"{root}/raw/manifests"):
        return spark.createDataFrame([], f"{CAPTURE}, secret boolean")
    return spark.read.schema(CAPTURE).json(f"{root}/raw/manifests").withColumn("secret", parse.has_secret_key(F.col("parameters")))


#: What the footer contract of a stored dataset states.
CONTRACT = ("format", "format_version", "dataset", "key", "schema_version", "codec", "schema")


class TypedStore:
    """Datasets of canonical records under one root, each with a contract in every file's footer that every reader checks."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def path(self, name: str) -> str:
        return f"{self.root}/curated/{DATASETS[name].name}"

    def contract(self, name: str) -> dict:
        d = DATASETS[name]
        values = ("typed-parquet", "1", d.name, d.key, VERSION, "zstd", files.sha256(d.schema.json().encode()))
        return dict(zip(CONTRACT, values))

    def persist(self, name: str, records: DataFrame) -> bool:
        """Checks the records' constraints and upserts them; True if anything changed."""
        if self.read_only:
            raise PermissionError(f"{self.root} is read only")
        d = DATASETS[name]
        records = records.withColumn("schema_version", F.lit(VERSION)) if "schema_version" not in records.columns else records
        records = stored(records.to(d.schema))
        bad = violations(records, name).take(3)
        if bad:
            raise ValueError(f"{name}: " + "; ".join(f"{r[0]}: {', '.join(r['broken'])}" for r in bad))
        return upsert(self.spark, self.path(name), records, d.key, F.xxhash64(F.to_json(F.struct(*(f for f in d.schema.fieldNames() if f != d.key)))), self.contract(name), at_hand=True)

    def load(self, name: str) -> DataFrame:
        """The records; none without the dataset. A part file whose footer states another contract than the one expected raises, with its name."""
        d = DATASETS[name]
        check_footers(self.spark, self.path(name), d.key, self.contract(name))
        return read_dataset(self.spark, self.path(name), d.schema)

    def counts(self) -> DataFrame:
        """(dataset, records) of every dataset, zero without one."""
        parts = [self.load(n).agg(F.lit(n).alias("dataset"), F.count("*").alias("records")) for n in DATASETS]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def inventory(self) -> DataFrame:
        """(dataset, record_id, payload_sha256) of every record of every dataset."""
        parts = [self.load(n).select(F.lit(n).alias("dataset"), F.col(d.key).alias("record_id"), F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("payload_sha256")) for n, d in DATASETS.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def views(self) -> list[str]:
        """One temporary view for each dataset, by sorted name, rebuilt from what is stored."""
        for name in sorted(DATASETS):
            self.load(name).createOrReplaceTempView(name)
        return sorted(DATASETS)


@dataclass(frozen=True)
class Inputs:
    """What a study is frozen from: all datasets, staging rows by name, and its control documents."""

    datasets: dict[str, DataFrame]
    staging: dict[str, DataFrame]
    documents: dict[str, dict]
    inventory: DataFrame


#: The control documents of a prepared study.
DOCUMENTS = ("config", "protocol", "controls", "prices", "origins")


def read_inputs(spark: SparkSession, root: str) -> Inputs:
    """Reads a prepared study; a missing control document raises, a missing dataset is empty."""
    store = TypedStore(spark, root, read_only=True)
    held = {n: files.read(spark, f"{root}/{n}.json") for n in DOCUMENTS}
    lacking = [n for n, body in held.items() if body is None]
    if lacking:
        raise FileNotFoundError(", ".join(lacking))
    names = sorted({p.split("/")[0] for p in files.listed(spark, f"{root}/staging")})
    staging = {n: spark.read.parquet(f"{root}/staging/{n}") for n in names}
    return Inputs({n: store.load(n) for n in DATASETS}, staging, {n: json.loads(b) for n, b in held.items()}, store.inventory())
