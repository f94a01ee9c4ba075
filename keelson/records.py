"""Canonical records: one explicit schema for each dataset, its key, its constraints, and generated schema documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import checks

#: The version and the fields of the stored records.
VERSION = "1.0.0"
TEMPORAL = "struct<raw_value:string,precision:string,year:int,month:int,day:int,timestamp:timestamp,source_timezone:string>"
LINEAGE = "struct<source_family:string,underlying_source_family:string,observation_role:string>"
PARTY = "struct<entity_id:string,role:string>"
SUBJECT = "struct<subject_type:string,subject_id:string>"
VALUE = "struct<name:string,kind:string,value:decimal(38,18),currency:string,unit:string>"
RANGE = "struct<name:string,raw_text:string,lower_bound:decimal(38,18),upper_bound:decimal(38,18),currency:string,unit:string>"
ATTRIBUTE = "struct<name:string,value_type:string,text:string,number:decimal(38,18),flag:boolean,raw_value:string>"
CLAIM = f"external_identifier_id:string,subject_type:string,subject_id:string,identifier_type:string,value:string,namespace:string,market_scope:string,source_observation_id:string,provenance_id:string,valid_from:{TEMPORAL},valid_to:{TEMPORAL},known_from:{TEMPORAL},observed_at:timestamp"
ALIAS = f"struct<entity_alias_id:string,entity_id:string,value:string,alias_type:string,source_observation_id:string,provenance_id:string,valid_from:{TEMPORAL},valid_to:{TEMPORAL},known_from:{TEMPORAL},observed_at:timestamp>"
METHOD = "struct<methodology_version:string,calendar_id:string,entry_convention:string,exit_convention:string,price_adjustment:string,price_source_observation_ids:array<string>>"


@dataclass(frozen=True)
class Dataset:
    name: str
    key: str
    fields: str

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(f"struct<{self.fields},schema_version:string>")


_ALL = [
    Dataset("source_observations", "source_observation_id", f"source_observation_id:string,provider_namespace:string,source_native_id:string,lineage:{LINEAGE},retrieved_at:timestamp,observed_at:timestamp,public_time:{TEMPORAL},raw_sha256:string,adapter_version:string,parser_version:string,source_locator:string,retention_class:string,license_name:string"),
    Dataset("provenance", "provenance_id", "provenance_id:string,source_observation_ids:array<string>,parent_provenance_ids:array<string>,derivation_kind:string,derived_at:timestamp,transform_version:string"),
    Dataset("event_evidence", "event_evidence_id", "event_evidence_id:string,event_id:string,source_observation_ids:array<string>,provenance_id:string"),
    Dataset("events", "event_id", f"event_id:string,event_type:string,actors:array<{PARTY}>,economic_units:array<{PARTY}>,issuer_entity_id:string,security_id:string,listing_id:string,occurrence_time:{TEMPORAL},public_time:{TEMPORAL},actionable_at:timestamp,financial_values:array<{VALUE}>,disclosed_ranges:array<{RANGE}>,attributes:array<{ATTRIBUTE}>,event_evidence_ids:array<string>,provenance_id:string"),
    Dataset("entities", "entity_id", f"entity_id:string,entity_type:string,display_name:string,aliases:array<{ALIAS}>,external_identifiers:array<struct<{CLAIM}>>,provenance_id:string"),
    Dataset("external_identifiers", "external_identifier_id", CLAIM),
    Dataset("securities", "security_id", f"security_id:string,issuer_entity_id:string,security_type:string,display_name:string,share_class:string,external_identifiers:array<struct<{CLAIM}>>,provenance_id:string"),
    Dataset("listings", "listing_id", f"listing_id:string,security_id:string,symbol:string,exchange_mic:string,effective_from:{TEMPORAL},effective_to:{TEMPORAL},external_identifiers:array<struct<{CLAIM}>>,provenance_id:string"),
    Dataset("relationships", "relationship_id", f"relationship_id:string,relationship_type:string,source:{SUBJECT},target:{SUBJECT},valid_from:{TEMPORAL},valid_to:{TEMPORAL},known_from:{TEMPORAL},known_to:{TEMPORAL},observed_at:timestamp,confidence:decimal(38,18),source_observation_ids:array<string>,provenance_id:string"),
    Dataset("feature_snapshots", "feature_snapshot_id", f"feature_snapshot_id:string,event_id:string,snapshot_at:timestamp,feature_version:string,features:array<struct<feature_value_id:string,name:string,text:string,number:decimal(38,18),known_from:{TEMPORAL},source_observation_ids:array<string>>>,provenance_id:string"),
    Dataset("outcomes", "outcome_id", f"outcome_id:string,event_id:string,security_id:string,listing_id:string,actionable_at:timestamp,entry_at:timestamp,exit_at:timestamp,horizon_sessions:int,entry_price:decimal(38,18),exit_price:decimal(38,18),security_return:decimal(38,18),benchmark_listing_id:string,benchmark_return:decimal(38,18),excess_return:decimal(38,18),status:string,methodology:{METHOD},exclusion_reason:string,provenance_id:string"),
]
DATASETS = {d.name: d for d in _ALL}


def rules(name: str) -> dict[str, Column]:
    """The constraints of a dataset's records, by name: true where a record obeys."""
    c, unique, sure = F.col, checks.unique, checks.sure
    found = {"version": sure(c("schema_version") == VERSION), "key": sure(F.length(F.trim(DATASETS[name].key)) > 0)}
    temporal = lambda *fields: {f: c(f).isNull() | checks.temporal_value(c(f)) for f in fields}
    if name == "source_observations":
        found |= {"role": sure(c("lineage.observation_role").isin("primary_source", "vendor_normalized", "enrichment", "synthetic")), "hash": sure(c("raw_sha256").rlike("^[0-9a-f]{64}$")), "retention": sure(c("retention_class").isin("public", "restricted", "internal", "unknown"))} | temporal("public_time")
    elif name == "provenance":
        found |= {"sources": sure(F.size("source_observation_ids") > 0) & unique(c("source_observation_ids")), "parents": unique(F.coalesce("parent_provenance_ids", F.array()))}
    elif name == "event_evidence":
        found |= {"sources": sure(F.size("source_observation_ids") > 0) & unique(c("source_observation_ids"))}
    elif name == "events":
        names = F.concat(*(F.coalesce(F.transform(f, lambda x: x["name"]), F.array().cast("array<string>")) for f in ("financial_values", "disclosed_ranges", "attributes")))
        found |= {
            "listing_needs_security": c("listing_id").isNull() | c("security_id").isNotNull(),
            "security_needs_issuer": c("security_id").isNull() | c("issuer_entity_id").isNotNull(),
            "actors": unique(F.coalesce("actors", F.array().cast(f"array<{PARTY}>"))),
            "economic_units": unique(F.coalesce("economic_units", F.array().cast(f"array<{PARTY}>"))),
            "names": unique(names),
            "evidence": sure(F.size("event_evidence_ids") > 0) & unique(c("event_evidence_ids")),
            "units": sure(F.forall(F.coalesce("financial_values", F.array().cast(f"array<{VALUE}>")), checks.financial_units)),
            "ranges": sure(F.forall(F.coalesce("disclosed_ranges", F.array().cast(f"array<{RANGE}>")), lambda r: checks.range_ordered(r["lower_bound"], r["upper_bound"]))),
            "attributes": sure(F.forall(F.coalesce("attributes", F.array().cast(f"array<{ATTRIBUTE}>")), checks.typed_attribute)),
        } | temporal("occurrence_time", "public_time")
    elif name == "external_identifiers":
        found |= {"subject": checks.identifier_subject(c("identifier_type"), c("subject_type"), c("market_scope")), "namespace": sure((c("identifier_type") == "other") == c("namespace").isNotNull())}
    elif name in ("entities", "securities", "listings"):
        kind, key = {"entities": ("entity", "entity_id"), "securities": ("security", "security_id"), "listings": ("listing", "listing_id")}[name]
        claims = F.coalesce("external_identifiers", F.array().cast(f"array<struct<{CLAIM}>>"))
        found |= {"claims": sure(F.forall(claims, lambda x: (x["subject_type"] == kind) & (x["subject_id"] == c(key)))) & unique(F.transform(claims, lambda x: x["external_identifier_id"]))}
        if name == "entities":
            found |= {"aliases": sure(F.forall(F.coalesce("aliases", F.array().cast(f"array<{ALIAS}>")), lambda x: x["entity_id"] == c("entity_id")))}
        if name == "listings":
            found |= {"venue": sure(c("exchange_mic").rlike("^[A-Z0-9]{4}$"))} | temporal("effective_from", "effective_to")
    elif name == "relationships":
        found |= {"sources": sure(F.size("source_observation_ids") > 0) & unique(c("source_observation_ids")), "confidence": F.coalesce(c("confidence").between(0, 1), F.lit(True))}
    elif name == "outcomes":
        found |= checks.outcome_rules()
    return found


def violations(records: DataFrame, name: str) -> DataFrame:
    """(key, broken): the names of the rules that a record breaks, sorted; none for a record that obeys all."""
    broken = F.array_sort(F.filter(F.array(*(F.when(~ok, F.lit(rule)) for rule, ok in rules(name).items())), lambda x: x.isNotNull()))
    return records.select(DATASETS[name].key, broken.alias("broken")).filter(F.size("broken") > 0)


def documents() -> dict[str, str]:
    """A schema document for each dataset, by file name: the same text for the same schema."""
    return {f"{d.name}.schema.json": json.dumps({"dataset": d.name, "key": d.key, "version": VERSION, "schema": d.schema.jsonValue()}, sort_keys=True, indent=1) + "\n" for d in _ALL}


def drift(stored: dict[str, str]) -> dict[str, str]:
    """File name and what is wrong with it: missing, changed, or not declared."""
    now = documents()
    states = {n: "missing" if n not in stored else "changed" if stored[n] != now[n] else None for n in now} | {n: "undeclared" for n in stored if n not in now}
    return {n: s for n, s in sorted(states.items()) if s}
