"""Integrity of a set of canonical records: references, origins, contamination, and what each record rests on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import ancestors, cover, orphans

#: (dataset, what refers, the dataset that must have it). A reference is one id, or an array of them.
REFERENCES: list[tuple[str, str, str]] = [
    ("provenance", "source_observation_ids", "source_observations"),
    ("provenance", "parent_provenance_ids", "provenance"),
    ("event_evidence", "event_id", "events"),
    ("event_evidence", "provenance_id", "provenance"),
    ("event_evidence", "source_observation_ids", "source_observations"),
    ("events", "provenance_id", "provenance"),
    ("events", "event_evidence_ids", "event_evidence"),
    ("events", "issuer_entity_id", "entities"),
    ("events", "security_id", "securities"),
    ("events", "listing_id", "listings"),
    ("events", "actors.entity_id", "entities"),
    ("events", "economic_units.entity_id", "entities"),
    ("entities", "provenance_id", "provenance"),
    ("entities", "aliases.source_observation_id", "source_observations"),
    ("entities", "aliases.provenance_id", "provenance"),
    ("entities", "external_identifiers.source_observation_id", "source_observations"),
    ("entities", "external_identifiers.provenance_id", "provenance"),
    ("securities", "issuer_entity_id", "entities"),
    ("securities", "provenance_id", "provenance"),
    ("securities", "external_identifiers.source_observation_id", "source_observations"),
    ("securities", "external_identifiers.provenance_id", "provenance"),
    ("listings", "security_id", "securities"),
    ("listings", "provenance_id", "provenance"),
    ("listings", "external_identifiers.source_observation_id", "source_observations"),
    ("listings", "external_identifiers.provenance_id", "provenance"),
    ("external_identifiers", "source_observation_id", "source_observations"),
    ("external_identifiers", "provenance_id", "provenance"),
    ("relationships", "provenance_id", "provenance"),
    ("relationships", "source_observation_ids", "source_observations"),
]
#: Ends and subjects whose dataset goes by their type.
TYPED: list[tuple[str, str]] = [("external_identifiers", ""), ("relationships", "source."), ("relationships", "target.")]
KINDS = {"entity": "entities", "security": "securities", "listing": "listings"}


def references(datasets: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(dataset, record_id, field, target, target_id) of every reference that a record makes; nulls make none."""
    parts = []
    row = lambda df, name, field, target, value: df.select(F.lit(name).alias("dataset"), F.col(keys[name]).alias("record_id"), F.lit(field).alias("field"), target.alias("target"), value.alias("target_id"))
    for name, field, target in REFERENCES:
        if name in datasets and target in datasets:
            many = datasets[name].select(field).schema[0].dataType.typeName() == "array"
            value = F.explode(field) if many else F.col(field)
            parts.append(row(datasets[name], name, field, F.lit(target), value))
    table = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    for name, prefix in TYPED:
        if name in datasets:
            parts.append(row(datasets[name], name, prefix + "subject_id", F.element_at(table, F.col(prefix + "subject_type")), F.col(prefix + "subject_id")))
    return reduce(DataFrame.union, parts).filter("target_id IS NOT NULL")


def broken_references(datasets: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """References whose target is not there. One anti-join on (dataset, id) serves all kinds of reference."""
    there = reduce(DataFrame.union, [df.select(F.lit(n).alias("its_dataset"), F.col(keys[n]).alias("its_id")) for n, df in datasets.items()])
    made = references(datasets, keys)
    return made.join(there, (made.target == there.its_dataset) & (made.target_id == there.its_id), "left_anti")


def foreign_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, event_evidence_id): evidence that an event names and that belongs to another event."""
    named = events.select("event_id", F.explode("event_evidence_ids").alias("event_evidence_id"))
    return named.join(evidence.select("event_evidence_id", F.col("event_id").alias("its_event")), "event_evidence_id").filter("event_id <> its_event").select("event_id", "event_evidence_id")


def contaminated(origins: DataFrame, observations: DataFrame, mode: str, providers: tuple[str, ...]) -> DataFrame:
    """(what, id, reason): support that a run of a mode must not have. A synthetic run may have any.

    ``origins`` has record_id and origin, ``observations`` observation_id, provider, role and retention.
    """
    real, strict = F.lit(mode != "synthetic"), F.lit(mode in ("discovery", "validation"))
    origin = F.when(real & (F.col("origin") == "synthetic"), "synthetic_origin").when(strict & (F.col("origin") == "unverified"), "unverified_origin")
    source = F.when(~F.col("provider").isin(*providers), "unreviewed_provider").when(F.col("role") == "synthetic", "synthetic_role").when(F.col("retention") == "internal", "internal_retention")
    a = origins.select(F.lit("origin").alias("what"), F.col("record_id").cast("string").alias("id"), origin.alias("reason"))
    b = observations.filter(real).select(F.lit("observation").alias("what"), F.col("observation_id").cast("string").alias("id"), source.alias("reason"))
    return a.union(b).filter("reason IS NOT NULL")


def uncovered_origins(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """Records whose declared origin is missing, stale or of nothing: (dataset, record_id, state)."""
    return cover(declared, inventory, ["dataset", "record_id"], "payload_sha256").filter("state <> 'match'")


def support(provenance: DataFrame, depth: int = 128) -> DataFrame:
    """(provenance_id, observation_ids, observations): all observations that a derivation rests on, through all its parents."""
    edges = provenance.select(F.col("provenance_id").alias("node"), F.explode_outer("parent_provenance_ids").alias("parent"))
    walk = ancestors(provenance.sparkSession, edges, depth)
    seen = provenance.select(F.col("provenance_id").alias("ancestor"), F.explode("source_observation_ids").alias("o"))
    return walk.join(seen, "ancestor").groupBy(F.col("node").alias("provenance_id")).agg(F.array_sort(F.collect_set("o")).alias("observation_ids")).withColumn("observations", F.size("observation_ids"))


def derived_at(rows: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """(row_id, derived_at): the latest of the analysis time and the times its observations were made; rows have observation_ids."""
    seen = rows.select("row_id", F.explode_outer("observation_ids").alias("observation_id")).join(observations.select("observation_id", "observed_at"), "observation_id", "left")
    return seen.groupBy("row_id").agg(F.greatest(as_of, F.coalesce(F.max("observed_at"), as_of)).alias("derived_at"))


def inspection_span(rows: DataFrame) -> DataFrame:
    """(first, last): the days that computed outcomes have looked at."""
    return rows.agg(F.min("entry_date").alias("first"), F.max(F.greatest("entry_date", "exit_date")).alias("last"))


def integrity(datasets: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(problem, n): how many of each kind of problem the records have; no rows if they are sound."""
    broken = broken_references(datasets, keys).groupBy(F.concat(F.lit("missing "), "target", F.lit(" of "), "dataset", F.lit("."), "field").alias("problem")).agg(F.count("*").alias("n"))
    foreign = foreign_evidence(datasets["events"], datasets["event_evidence"]).agg(F.lit("evidence of another event").alias("problem"), F.count("*").alias("n")).filter("n > 0")
    return broken.union(foreign)


def missing_objects(observations: DataFrame, objects: DataFrame) -> DataFrame:
    """Observations whose raw bytes are not stored, or not under their own hash; objects are (sha256, object_path)."""
    sound = objects.filter(F.element_at(F.split("object_path", "/"), -1) == F.col("sha256")).select(F.col("sha256").alias("raw_sha256"))
    return orphans(observations, "raw_sha256", sound, "raw_sha256")


def record_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, records) of each dataset."""
    return reduce(DataFrame.union, [df.agg(F.lit(n).alias("dataset"), F.count("*").alias("records")) for n, df in datasets.items()])
