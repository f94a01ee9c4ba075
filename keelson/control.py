"""Control of studies: registration, inspection journal, approval, verification, archives, layouts and generations.

All of it is small: documents in canonical JSON, written once, on any file system that Spark reaches. What
is of the data's size (rows, records) is compared as DataFrames.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.intervals import interval_overlaps
from .operators.lineage import differences
from .sources import files
from .sources.files import ConflictError, ObjectStore, canonical_json, sha256

NAMESPACE = uuid.NAMESPACE_OID
#: Mandatory and allowed horizons, in sessions.
MANDATORY, ALLOWED = {20, 60, 90}, {5, 20, 60, 90, 120}
REAL_MODES = ("discovery", "validation")


class NotApproved(PermissionError):
    """What a study may not do without a review."""


def digest_of(value: dict) -> str:
    return sha256(canonical_json(value))


@dataclass(frozen=True)
class Protocol:
    """What a study declares before it looks at an outcome."""

    hypothesis_id: str
    version: str
    event_types: tuple[str, ...]
    source_families: tuple[str, ...]
    features: tuple[str, ...]
    feature_definitions: tuple[str, ...]
    discovery: tuple[str, str]
    validation: tuple[str, str]
    horizons: tuple[int, ...] = (20, 60, 90)

    def __post_init__(self) -> None:
        for first, last in (self.discovery, self.validation):
            if first > last:
                raise ValueError("a period starts after its end")
        if self.discovery[1] >= self.validation[0]:
            raise ValueError("discovery and validation overlap")
        if set(self.features) != set(self.feature_definitions):
            raise ValueError("definitions must cover the declared features exactly")
        if not MANDATORY <= set(self.horizons):
            raise ValueError("the horizons of 20, 60 and 90 sessions are mandatory")

    @property
    def digest(self) -> str:
        return digest_of(asdict(self))


@dataclass(frozen=True)
class BuildConfig:
    mode: str
    period: tuple[str, str]
    as_of: str
    coverage_through: str
    features: tuple[str, ...]
    horizons: tuple[int, ...] = (20, 60, 90)
    benchmark_security_id: str | None = None
    benchmark_listing_id: str | None = None
    output_rights: str = "public"
    restricted_raw_retention_permitted: bool = False
    restricted_derivatives_permitted: bool = False
    license_review_reference: str | None = None

    def __post_init__(self) -> None:
        h = set(self.horizons)
        if not MANDATORY <= h or not h <= ALLOWED or len(h) != len(self.horizons) or len(set(self.features)) != len(self.features):
            raise ValueError("unsupported, missing or repeated horizons or features")
        if self.period[0] > self.period[1]:
            raise ValueError("a period starts after its end")
        if (self.benchmark_security_id is None) != (self.benchmark_listing_id is None):
            raise ValueError("the benchmark's security and listing must resolve together")


def control_defects(bindings: DataFrame, controls: DataFrame) -> DataFrame:
    """(event_id, defect) of reviewed bindings and controls: repeated events, and terminal states without date or evidence."""
    twice = lambda df, what: df.groupBy("event_id").count().filter("count > 1").select("event_id", F.lit(what).alias("defect"))
    half = controls.filter(F.col("terminal_date").isNull() != F.col("terminal_observation_id").isNull()).select("event_id", F.lit("terminal_without_date_or_evidence").alias("defect"))
    return twice(bindings, "repeated_binding").union(twice(controls, "repeated_control")).union(half)


# --- registration and journal


def inspections(spark: SparkSession, registry: str) -> DataFrame:
    """(attempt_id, mode, first, last): what each attempt has looked at, or may have if it never finished; attempts that looked at nothing are left out."""
    rows = []
    for path in files.listed(spark, f"{registry}/attempts"):
        if not path.endswith(".started.json"):
            continue
        begun = json.loads(files.read(spark, f"{registry}/attempts/{path}"))
        ended = files.read(spark, f"{registry}/attempts/{path.replace('.started.', '.finished.')}")
        end = json.loads(ended) if ended else None
        if begun["mode"] not in REAL_MODES or end and not end["outcome_inspection"]:
            continue
        first, last = (end or {}).get("inspection_period") or begun["period"]
        rows.append((begun["attempt_id"], begun["mode"], first, last if end else max(last, begun["coverage_through"])))
    found = spark.createDataFrame(rows, "attempt_id string, mode string, first string, last string")
    return found.select("attempt_id", "mode", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


def overlapping_inspections(spark: SparkSession, registry: str, period: tuple[str, str]) -> DataFrame:
    window = spark.createDataFrame([period], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    return interval_overlaps(inspections(spark, registry), window, ("first", "last"), ("a", "b"))


def register(spark: SparkSession, registry: str, protocol: Protocol, origins_sha256: str, code_sha256: str, *, approval: str, uninspected: bool, at: str) -> dict:
    """Registers a protocol once; the same again is no change. A validation window that was or may have been looked at raises."""
    if not uninspected or not approval.strip():
        raise NotApproved("an approval and an attestation that the window is uninspected are needed")
    path = f"{registry}/registrations/{protocol.digest}.json"
    body = {"registration_id": str(uuid.uuid5(NAMESPACE, protocol.digest)), "protocol_sha256": protocol.digest, "origins_sha256": origins_sha256, "code_sha256": code_sha256, "approval": approval}
    held = files.read(spark, path)
    if held:
        before = json.loads(held)
        if {k: v for k, v in before.items() if k != "approved_at"} != body:
            raise ConflictError("a registered protocol does not change; an amendment needs a review of its own")
        return before
    if not overlapping_inspections(spark, registry, protocol.validation).isEmpty():
        raise NotApproved("the validation window was, or may have been, inspected")
    files.write_once(spark, path, canonical_json(body | {"approved_at": at}))
    return body | {"approved_at": at}


def require_registration(spark: SparkSession, registry: str, protocol: Protocol, origins_sha256: str, code_sha256: str) -> dict:
    held = files.read(spark, f"{registry}/registrations/{protocol.digest}.json")
    found = json.loads(held) if held else {}
    if (found.get("origins_sha256"), found.get("code_sha256")) != (origins_sha256, code_sha256):
        raise NotApproved("no registration of this protocol with these inputs and this code")
    return found


def start_attempt(spark: SparkSession, registry: str, snapshot_id: str, protocol: Protocol, config: BuildConfig, at: str) -> str:
    """Writes that an attempt begins, before it looks at anything; its id."""
    attempt = str(uuid.uuid4())
    body = {"attempt_id": attempt, "snapshot_id": snapshot_id, "protocol_sha256": protocol.digest, "mode": config.mode, "period": list(config.period), "coverage_through": config.coverage_through, "started_at": at}
    files.write_once(spark, f"{registry}/attempts/{attempt}.started.json", canonical_json(body))
    return attempt


def finish_attempt(spark: SparkSession, registry: str, attempt: str, *, inspected: bool, success: bool, at: str, period: tuple[str, str] | None = None) -> None:
    body = {"outcome_inspection": inspected, "success": success, "finished_at": at} | ({"inspection_period": list(period)} if period else {})
    files.write_once(spark, f"{registry}/attempts/{attempt}.finished.json", canonical_json(body))


def scope_attempt(spark: SparkSession, registry: str, attempt: str, plan_sha256: str | None, result_sha256: str | None) -> None:
    files.write_once(spark, f"{registry}/attempts/{attempt}.analysis.json", canonical_json({"plan_sha256": plan_sha256, "result_sha256": result_sha256}))


#: What an approval must name exactly.
APPROVED = ("protocol_sha256", "plan_sha256", "code_sha256", "dependencies_sha256", "origins_sha256", "snapshot_sha256", "snapshot_id", "registry")


def require_approval(spark: SparkSession, registry: str, approval: dict, scope: dict, attempt: str) -> None:
    """Raises unless an approval names this very scope, and all inspections are in its history or of its scope."""
    wrong = [k for k in APPROVED if approval.get(k) != scope.get(k) or scope.get(k) is None]
    if wrong:
        raise NotApproved(f"the approval is of another {', '.join(wrong)}")
    folder = f"{registry}/attempts"
    now = files.listed(spark, folder)
    for name, expected in approval.get("preserved_history", {}).items():
        if name not in now or sha256(files.read(spark, f"{folder}/{name}")) != expected:
            raise NotApproved("the history of inspections is missing or has changed")
    for name in now:
        stem = name.split(".")[0]
        if name in approval.get("preserved_history", {}) or stem == attempt:
            continue
        begun, scoped = (files.read(spark, f"{folder}/{stem}.{kind}.json") for kind in ("started", "analysis"))
        same = begun and scoped and json.loads(begun)["snapshot_id"] == scope["snapshot_id"] and json.loads(begun)["protocol_sha256"] == scope["protocol_sha256"] and json.loads(scoped)["plan_sha256"] == scope["plan_sha256"]
        if not same:
            raise NotApproved("an inspection is in no reviewed history")


# --- rights


def rights_defect(observations: DataFrame, config: BuildConfig, private_root: bool) -> str | None:
    """Why what is built must not be written where it is to go; restricted or unknown sources need every permission and a private root."""
    restricted = not observations.filter(~F.col("retention_class").isin("public", "internal")).isEmpty()
    if not restricted:
        return None
    lacking = [name for name, there in (("output_rights", config.output_rights == "private_only"), ("restricted_raw_retention_permitted", config.restricted_raw_retention_permitted), ("restricted_derivatives_permitted", config.restricted_derivatives_permitted), ("license_review_reference", bool(config.license_review_reference)), ("private_root", private_root)) if not there]
    return f"restricted sources without {', '.join(lacking)}" if lacking else None


# --- verification


def verified_result(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): rows that a stored result lacks, has too many or has otherwise than its inputs give. No rows: it is verified."""
    columns = sorted(again.columns)
    left, right = differences(stored.select(*columns), again.select(*columns))
    changed = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")
    only = lambda df, what: df.select(*keys).distinct().join(changed, keys, "left_anti").withColumn("problem", F.lit(what))
    return changed.withColumn("problem", F.lit("changed")).unionByName(only(left, "unexpected")).unionByName(only(right, "missing"))


def incomplete_inventory(rows: DataFrame, events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(event_id, horizon) that a result must have once and has never or more than once, or that it must not have."""
    wanted = events.select("event_id", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).withColumn("wanted", F.lit(True))
    found = rows.groupBy("event_id", "horizon").agg(F.count("*").alias("n"))
    return wanted.join(found, ["event_id", "horizon"], "full_outer").filter("wanted IS NULL OR n IS NULL OR n <> 1").select("event_id", "horizon")


# --- archives and layouts


def inventory_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, length) of every file below a root."""
    if not files.listed(spark, root):
        return spark.createDataFrame([], "path string, sha256 string, length long")
    base = files.at(spark, root)
    prefix = base[0].makeQualified(base[1]).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return found.select(F.substring(plain, len(re.sub("^file:/+", "file:/", prefix)) + 1, 1 << 20).alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def seal(spark: SparkSession, root: str, archive: str) -> str:
    """Seals the files below a root: the id of a manifest that names each by its hash, written once."""
    entries = [r.asDict() for r in inventory_of(spark, root).orderBy("path").collect()]
    if not entries or not all(files.safe_path(e["path"]) for e in entries):
        raise ValueError("nothing to seal, or a path that no archive may have")
    body = canonical_json({"entries": entries})
    files.write_once(spark, f"{archive}/{sha256(body)}.json", body)
    return sha256(body)


def archive_defects(spark: SparkSession, root: str, archive: str, sealed: str, groups: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """What is wrong with a sealed root: a broken manifest, files that are missing, changed or not in it, or one of a pair without the other.

    ``groups`` are pairs of patterns, such as plans and their approvals: what matches the first, with its
    first group put into the second, must be there.
    """
    body = files.read(spark, f"{archive}/{sealed}.json")
    if body is None or sha256(body) != sealed:
        return ["manifest"]
    stated = {e["path"]: e["sha256"] for e in json.loads(body)["entries"]}
    now = {r["path"]: r["sha256"] for r in inventory_of(spark, root).collect()}
    out = [f"missing {p}" for p in stated if p not in now] + [f"undeclared {p}" for p in now if p not in stated] + [f"changed {p}" for p in stated if p in now and now[p] != stated[p]]
    for pattern, other in groups:
        out += [f"alone {p}" for p in now if (m := re.fullmatch(pattern, p)) and other.format(*m.groups()) not in now]
    return sorted(out)


@dataclass(frozen=True)
class Bounds:
    """How large a durable layout may be."""

    file_bytes: int = 16 << 20
    total_bytes: int = 256 << 20
    files: int = 4096
    rows: int = 50_000


def layout_defects(spark: SparkSession, root: str, allowed: tuple[str, ...], bounds: Bounds = Bounds()) -> list[str]:
    """What a durable layout must not have: paths beyond the allowed patterns, unsafe names, and more than the bounds."""
    found = files.listed(spark, root)
    out = [f"unsafe {p}" for p in found if not files.safe_path(p)] + [f"not_allowed {p}" for p in found if not any(re.fullmatch(a, p) for a in allowed)]
    out += [f"too_large {p}" for p, n in found.items() if n > bounds.file_bytes]
    out += ["too_many_bytes"] if sum(found.values()) > bounds.total_bytes else []
    out += ["too_many_files"] if len(found) > bounds.files else []
    data = [p for p in found if p.endswith(".parquet")]
    if data:
        counts = spark.read.parquet(*(f"{root}/{p}" for p in data)).groupBy(F.input_file_name().alias("path")).count().filter(F.col("count") > bounds.rows)
        out += [f"too_many_rows {r['path'].rsplit('/', 1)[-1]}" for r in counts.collect()]
    return sorted(out)


# --- generations


def generation_of(spark: SparkSession, root: str, parent: str | None) -> dict:
    entries = [{"path": p, "size": n, "sha256": sha256(files.read(spark, f"{root}/{p}"))} for p, n in files.listed(spark, root).items()]
    return {"parent": parent, "entries": entries}


def head(store: ObjectStore) -> tuple[str | None, str | None]:
    """The current generation's id, and the tag of the pointer to it."""
    found = store.get("current.json")
    return (json.loads(found[0])["generation"], found[1]) if found else (None, None)


def load_generation(store: ObjectStore, generation: str) -> dict:
    found = store.get(f"generations/{generation}.json", 2 << 20)
    if found is None or sha256(found[0]) != generation:
        raise ConflictError(f"generation {generation} is missing or not what its name says")
    return json.loads(found[0])


def publish(store: ObjectStore, root: str, expected_parent: str | None, allowed: tuple[str, ...] = (".*",), bounds: Bounds = Bounds(), mutable: tuple[str, ...] = ()) -> str:
    """Publishes a layout as the next generation and moves the pointer to it, if the parent still is the expected one; its id.

    A layout without a change publishes nothing. A file of the parent may not go, and may change only where
    its path matches ``mutable``. Objects and manifest are read back before the pointer moves.
    """
    spark = store.spark
    parent, tag = head(store)
    if parent != expected_parent:
        raise ConflictError("another generation is current")
    wrong = layout_defects(spark, root, allowed, bounds)
    if wrong:
        raise ValueError("; ".join(wrong[:5]))
    body = generation_of(spark, root, parent)
    if parent:
        before = {e["path"]: e["sha256"] for e in load_generation(store, parent)["entries"]}
        now = {e["path"]: e["sha256"] for e in body["entries"]}
        if before == now:
            return parent
        bad = [p for p, h in before.items() if p not in now or now[p] != h and not any(re.fullmatch(m, p) for m in mutable)]
        if bad:
            raise ConflictError(f"{bad[0]} of the parent is gone or has changed")
    for e in body["entries"]:
        key = f"objects/{e['sha256']}"
        if store.get(key) is None:
            store.put(key, files.read(spark, f"{root}/{e['path']}"))
    manifest = canonical_json(body)
    generation = sha256(manifest)
    if store.get(f"generations/{generation}.json") is None:
        store.put(f"generations/{generation}.json", manifest)
    for e in load_generation(store, generation)["entries"]:
        found = store.get(f"objects/{e['sha256']}")
        if found is None or sha256(found[0]) != e["sha256"]:
            raise ConflictError(f"{e['path']} was not stored whole")
    store.put("current.json", canonical_json({"generation": generation}), tag)
    return generation


def restore(store: ObjectStore, target: str, generation: str | None = None, chain: int = 4096) -> str | None:
    """Writes a generation's files to an empty folder, each checked against its hash, and checks the chain of its parents; its id."""
    generation = generation or head(store)[0]
    if generation is None:
        return None
    if files.listed(store.spark, target):
        raise ConflictError(f"{target} is not empty")
    body = load_generation(store, generation)
    parent, seen = body["parent"], {generation}
    while parent:
        if parent in seen or len(seen) >= chain:
            raise ConflictError("the chain of generations has a loop or is too long")
        seen.add(parent)
        parent = load_generation(store, parent)["parent"]
    for e in body["entries"]:
        found = store.get(f"objects/{e['sha256']}")
        if found is None or sha256(found[0]) != e["sha256"]:
            raise ConflictError(f"{e['path']} is missing or has changed")
        files.write_once(store.spark, f"{target}/{e['path']}", found[0])
    return generation


def run_pipeline(store: ObjectStore, work: str, step, **limits) -> str:
    """Restores the current generation, lets ``step`` work on the folder, and publishes what it leaves."""
    parent = restore(store, work)
    step(work)
    return publish(store, work, parent, **limits)


def lost_inspections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Attempts of a parent that a candidate lacks, or says to have looked at less: (attempt_id, problem)."""
    b = after.select(F.col("attempt_id").alias("its_id"), F.col("first").alias("its_first"), F.col("last").alias("its_last"))
    both = before.join(b, F.col("attempt_id") == F.col("its_id"), "left")
    less: Column = (F.col("its_first") > F.col("first")) | (F.col("its_last") < F.col("last"))
    return both.select("attempt_id", F.when(F.col("its_id").isNull(), "removed").when(less, "downgraded").alias("problem")).filter("problem IS NOT NULL")
