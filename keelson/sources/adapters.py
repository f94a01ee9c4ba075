"""From what readers give to canonical datasets: one DataFrame for each dataset, keyed by deterministic ids.

An adapter never guesses: a row that can't become a record stays in ``mappings`` with its reason. Ids are
name-based, so the same capture gives the same records, and an upsert of them is no change.
"""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, parse, temporal
from ..functions.checks import require
from ..records import DATASETS, TEMPORAL, VERSION

#: The namespace of the ids that adapters make.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def made_id(kind: str, *parts: Column) -> Column:
    return ids.uuid5(NAMESPACE, ids.prefixed(F.lit(kind), *(p.cast("string") for p in parts)))


def conform(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows with all columns of a dataset, null where an adapter has nothing to say."""
    schema = DATASETS[dataset].schema
    have = set(rows.columns)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(VERSION).alias(f.name) if f.name == "schema_version" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def temporal_day(day: Column, raw: Column | None = None) -> Column:
    """A calendar day as a temporal value."""
    value = F.struct(F.coalesce(raw if raw is not None else day.cast("string"), day.cast("string")).alias("raw_value"), F.lit("day").alias("precision"), F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("source_timezone"))
    return F.when(day.isNotNull(), value).cast(TEMPORAL)


def temporal_instant(at: Column, raw: Column, zone: str) -> Column:
    value = F.struct(raw.alias("raw_value"), F.lit("second").alias("precision"), *(F.lit(None).cast("int").alias(c) for c in ("year", "month", "day")), at.alias("timestamp"), F.lit(zone).alias("source_timezone"))
    return F.when(at.isNotNull(), value).cast(TEMPORAL)


def observations(manifests: DataFrame, role: str, public: Column | None = None) -> DataFrame:
    """Source observations of captures: one for each source version, whatever the number of its captures; the first by time is kept."""
    rows = manifests.withColumn("source_observation_id", made_id("observation", F.col("provider_namespace"), F.col("source_family"), F.col("content_sha256")))
    first = F.row_number().over(Window.partitionBy("source_observation_id").orderBy("retrieved_at", "capture_id")) == 1
    rows = rows.withColumn("first", first).filter("first")
    lineage = F.struct(F.col("source_family").alias("source_family"), F.lit(None).cast("string").alias("underlying_source_family"), F.lit(role).alias("observation_role"))
    rows = rows.withColumn("lineage", lineage).withColumn("raw_sha256", F.col("content_sha256")).withColumn("source_native_id", F.col("capture_id"))
    rows = rows.withColumn("retrieved_at", F.to_timestamp("retrieved_at")).withColumn("observed_at", F.to_timestamp("retrieved_at"))
    if public is not None:
        rows = rows.withColumn("public_time", public)
    return conform(rows, "source_observations")


def provenance_of(observed: DataFrame, kind: str, version: str) -> DataFrame:
    """One derivation for each observation."""
    rows = observed.select(made_id("provenance", F.col("source_observation_id"), F.lit(version)).alias("provenance_id"), F.array("source_observation_id").alias("source_observation_ids"), F.array().cast("array<string>").alias("parent_provenance_ids"), F.lit(kind).alias("derivation_kind"), F.col("observed_at").alias("derived_at"), F.lit(version).alias("transform_version"))
    return conform(rows, "provenance")


def text_attribute(name: str, value: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(name).alias("name"), F.lit("text").alias("value_type"), value.cast("string").alias("text"), none.cast("decimal(38,18)").alias("number"), none.cast("boolean").alias("flag"), value.cast("string").alias("raw_value"))


def number_attribute(name: str, value: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(name).alias("name"), F.lit("decimal").alias("value_type"), none.cast("string").alias("text"), value.cast("decimal(38,18)").alias("number"), none.cast("boolean").alias("flag"), none.cast("string").alias("raw_value"))


def quantity(name: str, value: Column, unit: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("name"), F.lit("quantity").alias("kind"), value.cast("decimal(38,18)").alias("value"), none.alias("currency"), F.lit(unit).alias("unit"))


def money_value(name: str, value: Column, currency: str = "USD") -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit("monetary_amount").alias("kind"), value.cast("decimal(38,18)").alias("value"), F.lit(currency).alias("currency"), F.lit(None).cast("string").alias("unit"))


def present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def bound_entities(claims: DataFrame, kind: str) -> DataFrame:
    """(value, entity_id) of the claims of a kind; a value with two entities raises, before anything is derived from them.

    Not when read: several parts of a plan read this, and if more than one raises, Spark tells neither's reason.
    """
    found = claims.filter((F.col("identifier_type") == kind) & (F.col("subject_type") == "entity")).groupBy("value").agg(F.count_distinct("subject_id").alias("n"), F.min("subject_id").alias("entity_id"))
    twice = found.filter("n > 1").take(1)
    if twice:
        raise PySparkValueError(f"one external identifier of two entities: {kind} {twice[0]['value']}")
    return found.select("value", "entity_id")


def ownership_records(rows: DataFrame, observed: DataFrame, known: DataFrame, version: str = "ownership/1.0.0") -> dict[str, DataFrame]:
    """Datasets from ownership rows (see readers.ownership) with source_observation_id.

    ``known`` has the identifier claims that were accepted before. An issuer without one is a new entity;
    a reporting owner without one stays unresolved, as a name and a number don't say what it is.
    """
    rows = rows.filter("defect IS NULL").withColumn("cik", ids.registrant_number(F.col("issuer"))).withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version)))
    bound = bound_entities(known, "sec_cik")
    filings = rows.select("source_observation_id", "provenance_id", "cik", F.col("issuer_name"), "owners").distinct()
    issuer = bound.select(F.col("value").alias("cik"), F.col("entity_id").alias("bound_issuer"))
    filings = filings.join(issuer, "cik", "left").withColumn("issuer_entity_id", F.coalesce("bound_issuer", made_id("cik", F.col("cik"))))
    entities = filings.filter("bound_issuer IS NULL").groupBy(F.col("issuer_entity_id").alias("entity_id")).agg(F.min_by("issuer_name", "source_observation_id").alias("display_name"), F.min_by("provenance_id", "source_observation_id").alias("provenance_id"), F.lit("issuer").alias("entity_type"))
    owner = filings.select("source_observation_id", "provenance_id", F.explode("owners").alias("owner")).select("*", ids.registrant_number(F.col("owner")).alias("value"))
    owner = owner.join(bound, "value", "left")
    subjects = filings.select("source_observation_id", "provenance_id", F.col("cik").alias("value"), F.col("issuer_entity_id").alias("entity_id")).union(owner.filter("entity_id IS NOT NULL").select("source_observation_id", "provenance_id", "value", "entity_id")).distinct()
    seen = observed.select("source_observation_id", "observed_at", "public_time")
    claims = subjects.join(seen, "source_observation_id").select(made_id("claim", F.col("entity_id"), F.lit("sec_cik"), F.col("value"), F.col("source_observation_id")).alias("external_identifier_id"), F.lit("entity").alias("subject_type"), F.col("entity_id").alias("subject_id"), F.lit("sec_cik").alias("identifier_type"), "value", "source_observation_id", "provenance_id", "observed_at")
    party = F.struct(F.col("entity_id"), F.lit("reporting_owner").alias("role"))
    actors = owner.groupBy("source_observation_id").agg(F.array_sort(F.collect_set(F.when(F.col("entity_id").isNotNull(), party))).alias("actors"), F.array_sort(F.collect_set(F.when(F.col("entity_id").isNull(), F.col("value")))).alias("unresolved"))
    used = rows.filter("exclusion IS NULL AND row_index IS NOT NULL").join(filings.select("source_observation_id", "issuer_entity_id").distinct(), "source_observation_id").join(actors, "source_observation_id", "left").join(seen, "source_observation_id")
    coordinate = F.concat_ws("/", F.col("kind"), F.col("row_index").cast("string"))
    used = used.withColumn("event_id", made_id("event", F.col("accession"), coordinate)).withColumn("event_evidence_id", made_id("evidence", F.col("event_id"), F.col("source_observation_id")))
    values = present(F.when(F.col("shares").isNotNull(), quantity("transaction_shares", F.col("shares"), "shares")))
    attributes = present(text_attribute("accession", F.col("accession")), text_attribute("source_row", coordinate), text_attribute("transaction_code", F.col("code")), text_attribute("unresolved_owners", F.array_join("unresolved", ",")), F.when(F.col("price").isNotNull(), number_attribute("reported_price_per_share", F.col("price"))))
    events = used.select("event_id", F.when(F.col("code") == "P", "equity_purchase").otherwise("equity_sale").alias("event_type"), F.coalesce("actors", F.array().cast("array<struct<entity_id:string,role:string>>")).alias("actors"), "issuer_entity_id", temporal_day(F.col("transaction_date")).alias("occurrence_time"), "public_time", values.alias("financial_values"), attributes.alias("attributes"), F.array("event_evidence_id").alias("event_evidence_ids"), "provenance_id")
    evidence = used.select("event_evidence_id", "event_id", F.array("source_observation_id").alias("source_observation_ids"), "provenance_id")
    mappings = rows.filter("exclusion IS NOT NULL").select("source_observation_id", coordinate.alias("coordinate"), F.col("exclusion").alias("reason"))
    return {"provenance": provenance_of(observed, "normalization", version), "entities": conform(entities, "entities"), "external_identifiers": conform(claims, "external_identifiers"), "events": conform(events, "events"), "event_evidence": conform(evidence, "event_evidence"), "mappings": mappings}


#: The relationship categories that are read.
CATEGORIES = {1: "position", 2: "education", 3: "membership", 4: "family", 5: "donation", 6: "transaction", 7: "lobbying", 8: "social", 9: "professional", 10: "ownership", 11: "hierarchy", 12: "generic"}


def relationship_records(edges: DataFrame, nodes: DataFrame, observed: DataFrame, known: DataFrame, accepted: DataFrame, version: str = "graph/1.0.0") -> dict[str, DataFrame]:
    """Datasets from graph edges and nodes with source_observation_id (see readers.relationships and readers.graph_nodes).

    ``known`` are accepted claims of node numbers, ``accepted`` (source_id, semantic_hash, relationship_id)
    what was imported before: an edge that changed since raises, one that did not is reused as it is.
    """
    bound = bound_entities(known.filter("namespace = 'graph'"), "other")
    nodes = nodes.withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version))).join(bound, F.col("node").cast("string") == F.col("value"), "left")
    kind = F.when(F.col("primary_type") == "Person", "person").when(F.col("primary_type") == "Org", "organization")
    nodes = nodes.withColumn("entity_type", kind).withColumn("reused", F.col("entity_id").isNotNull()).withColumn("entity_id", F.when(kind.isNotNull(), F.coalesce("entity_id", made_id("graph-entity", F.col("node")))))
    entities = nodes.filter("entity_id IS NOT NULL AND NOT reused").groupBy("entity_id").agg(F.min_by("node_name", "source_observation_id").alias("display_name"), F.min("entity_type").alias("entity_type"), F.min_by("provenance_id", "source_observation_id").alias("provenance_id"))
    seen = observed.select("source_observation_id", "observed_at")
    claims = nodes.filter("entity_id IS NOT NULL").join(seen, "source_observation_id").select(made_id("claim", F.col("entity_id"), F.lit("graph"), F.col("node"), F.col("source_observation_id")).alias("external_identifier_id"), F.lit("entity").alias("subject_type"), F.col("entity_id").alias("subject_id"), F.lit("other").alias("identifier_type"), F.col("node").cast("string").alias("value"), F.lit("graph").alias("namespace"), "source_observation_id", "provenance_id", "observed_at")
    known_nodes = nodes.filter("entity_id IS NOT NULL").select("node", "entity_id").union(bound.select(F.col("value").cast("bigint"), "entity_id")).distinct()
    before = accepted.select(F.col("source_id").alias("its_id"), F.col("semantic_hash").alias("its_hash"))
    edges = edges.join(before, F.col("id") == F.col("its_id"), "left")
    edges = require(edges, F.coalesce(F.col("its_hash") == F.col("semantic_hash"), F.lit(True)), "a relationship that was accepted has changed")
    for side in (1, 2):
        edges = edges.join(known_nodes.select(F.col("node").alias(f"node{side}"), F.col("entity_id").alias(f"end{side}")), F.col(f"entity{side}_id") == F.col(f"node{side}"), "left")
    reason = F.when(F.col("category").isNull(), "unsupported_relationship_category").when(F.col("end1").isNull() | F.col("end2").isNull(), "unresolved_endpoint").when(F.col("its_hash").isNotNull(), "reused")
    edges = edges.withColumn("reason", reason).withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version)))
    end = lambda i: F.struct(F.lit("entity").alias("subject_type"), F.col(f"end{i}").alias("subject_id"))
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["raw_value"].alias("raw_value"), F.col(c)["precision"].alias("precision"), F.col(c)["year"].alias("year"), F.col(c)["month"].alias("month"), F.col(c)["day"].alias("day"), F.col(c)["timestamp"].alias("timestamp"), F.lit(None).cast("string").alias("source_timezone"))).cast(TEMPORAL)
    relations = edges.filter("reason IS NULL").join(seen, "source_observation_id").select(made_id("relationship", F.col("id")).alias("relationship_id"), F.col("category").alias("relationship_type"), end(1).alias("source"), end(2).alias("target"), value("start").alias("valid_from"), value("end").alias("valid_to"), "observed_at", F.array("source_observation_id").alias("source_observation_ids"), "provenance_id")
    mappings = edges.filter("reason IS NOT NULL").select("source_observation_id", F.concat(F.lit("relationships/"), "id").alias("coordinate"), "reason").union(nodes.filter("entity_id IS NULL").select("source_observation_id", F.concat(F.lit("entities/"), F.col("node").cast("string")), F.lit("unsupported_source_entity_type")))
    return {"provenance": provenance_of(observed, "enrichment", version), "entities": conform(entities, "entities"), "external_identifiers": conform(claims, "external_identifiers"), "relationships": conform(relations, "relationships"), "mappings": mappings}


#: What each vendor endpoint's rows must have, may have, and mean.
ENDPOINTS = {
    "congress_v1": {"required": ("Representative", "Party"), "allowed": ("Representative", "BioGuideID", "ReportDate", "TransactionDate", "Ticker", "Transaction", "Range", "District", "House", "Amount", "Party", "last_modified", "TickerType", "Description"), "occurrence": "TransactionDate", "reported": "ReportDate", "amount": "Amount", "name": "Representative", "trade": True},
    "congress_v2": {"required": ("Traded", "Name", "BioGuideID", "Filed", "Party", "Chamber"), "allowed": ("Ticker", "TickerType", "Company", "Traded", "Transaction", "Trade_Size_USD", "Status", "Subholding", "Description", "Name", "BioGuideID", "Filed", "Party", "District", "Chamber", "Comments", "Quiver_Upload_Time", "State", "last_modified"), "occurrence": "Traded", "reported": "Filed", "amount": "Trade_Size_USD", "name": "Name", "trade": True},
    "contracts": {"required": ("Ticker", "Date", "action_date"), "allowed": ("Ticker", "Date", "Description", "Agency", "Amount", "action_date"), "occurrence": "action_date", "reported": "Date", "amount": "Amount", "name": None, "trade": False, "event": "government_contract", "value": "contract_obligated_amount"},
    "lobbying": {"required": ("Date", "Registrant", "Ticker"), "allowed": ("Date", "Amount", "Client", "Issue", "Specific_Issue", "Registrant", "Ticker"), "occurrence": None, "reported": "Date", "amount": "Amount", "name": None, "trade": False, "event": "lobbying_disclosure", "value": "reported_lobbying_spend"},
}
AUDIT_FIELDS = ("last_modified", "Quiver_Upload_Time")


def vendor_facts(rows: DataFrame, endpoint: str) -> DataFrame:
    """Typed facts of a vendor's rows (path, row_index, facts, quarantined; see readers.vendor_rows), with ``defect`` or ``reason``.

    A defect is a row that contradicts itself; a reason, one whose kind of transaction is not read. The
    hash is of the facts without audit fields; it is for comparison and never names an event.
    """
    e = ENDPOINTS[endpoint]
    f = lambda k: F.element_at("facts", k) if k else F.lit(None).cast("string")
    amount, raw_range = parse.money(F.regexp_replace(f(e["amount"]), "^-", "")), f("Range")
    signed = F.when(f(e["amount"]).startswith("-"), -amount).otherwise(amount)
    bounds = parse.disclosed_range(raw_range)
    both = raw_range.rlike(parse.RANGE)
    kind = F.when(F.lower(F.trim(f("Transaction"))) == "purchase", "equity_purchase").when(F.lower(F.trim(f("Transaction"))) == "sale", "equity_sale") if e["trade"] else F.lit(e["event"])
    occurrence, reported = parse.vendor_day(f(e["occurrence"])), parse.vendor_day(f(e["reported"]))
    lower = F.coalesce(bounds["lower"], signed)
    missing = F.array_join(F.array_except(F.array(*map(F.lit, e["required"])), F.map_keys("facts")), ",")
    person = f("BioGuideID")
    defect = (
        F.when(missing != "", F.concat(F.lit("missing_fields:"), missing))
        .when(occurrence > reported, "occurrence_after_report")
        .when(person.isNotNull() & ~person.rlike("^[A-Z][0-9]{6}$"), "bad_person_identifier")
        .when(F.lit(e["trade"]) & (signed < 0), "negative_trade_bound")
        .when(both & bounds.isNull(), "inverted_range")
        .when(both & signed.isNotNull() & (bounds["lower"] != signed), "range_contradicts_amount")
    )
    notes = present(F.when(occurrence.isNull(), F.lit("occurrence_time_not_supplied")), F.when(reported.isNull(), F.lit("reported_date_not_supplied")), F.when(raw_range.isNotNull() & ~both, F.lit("range_text_not_parsed")), F.lit("public_availability_requires_primary_evidence"))
    kept = F.map_filter("facts", lambda k, v: ~k.isin(*AUDIT_FIELDS))
    digest = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)
    return rows.select("path", "row_index", kind.alias("event_type"), occurrence.alias("occurrence_day"), reported.alias("reported_day"), parse.vendor_clock(f("last_modified")).alias("modified"), person.alias("person_id"), f(e["name"]).alias("person_name"), f("Ticker").alias("ticker_hint"), F.when(F.lit(e["trade"]), lower).alias("lower_bound"), F.when(F.lit(e["trade"]), bounds["upper"]).alias("upper_bound"), F.coalesce(raw_range, f(e["amount"])).alias("range_text"), F.when(~F.lit(e["trade"]), signed).alias("amount"), notes.alias("notes"), digest.alias("fact_hash"), "quarantined", defect.alias("defect"), F.when(defect.isNull() & kind.isNull(), "unsupported_transaction_classification").alias("reason"))


def linked_rows(facts: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Vendor rows with the event that a reviewed link names; a link whose row and event disagree raises when read.

    ``links`` has row_index, event_id and fact_hash. Type, day and range must agree as far as both state them.
    """
    own = events.select(F.col("event_id").alias("its_event"), F.col("event_type").alias("its_type"), temporal.calendar_day(F.col("occurrence_time")).alias("its_day"), F.col("disclosed_ranges")[0].alias("its_range"))
    both = facts.join(links.select("row_index", "event_id", F.col("fact_hash").alias("linked_hash")), "row_index", "left").join(own, F.col("event_id") == F.col("its_event"), "left")
    agree = lambda a, b: F.coalesce(a == b, F.lit(True))
    sound = (F.col("linked_hash") == F.col("fact_hash")) & F.col("its_event").isNotNull() & (F.col("event_type") == F.col("its_type")) & agree(F.col("occurrence_day"), F.col("its_day")) & agree(F.col("lower_bound"), F.col("its_range.lower_bound")) & agree(F.col("upper_bound"), F.col("its_range.upper_bound"))
    return require(both, F.col("event_id").isNull() | F.coalesce(sound, F.lit(False)), "a reviewed link disagrees with its row or event").drop("linked_hash", "its_event", "its_type", "its_day", "its_range")


def vendor_records(facts: DataFrame, observed: DataFrame, endpoint: str, version: str = "vendor/1.0.0") -> dict[str, DataFrame]:
    """Events of unlinked vendor rows without a defect or reason, each from its own source version; facts have source_observation_id."""
    rows = facts.filter("defect IS NULL AND reason IS NULL").withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version)))
    rows = rows.withColumn("event_id", made_id("vendor-event", F.lit(endpoint), F.col("source_observation_id"), F.col("row_index"))).withColumn("event_evidence_id", made_id("evidence", F.col("event_id"), F.col("source_observation_id")))
    unknown = F.struct(F.lit("not supplied").alias("raw_value"), F.lit("unknown").alias("precision"), *(F.lit(None).cast("int").alias(c) for c in ("year", "month", "day")), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("source_timezone")).cast(TEMPORAL)
    ranges = present(F.when(F.col("lower_bound").isNotNull() | F.col("upper_bound").isNotNull(), F.struct(F.lit("disclosed_transaction_amount").alias("name"), F.col("range_text").alias("raw_text"), "lower_bound", "upper_bound", F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("unit"))))
    values = present(F.when(F.col("amount").isNotNull(), money_value(ENDPOINTS[endpoint].get("value", "amount"), F.col("amount"))))
    events = rows.select("event_id", "event_type", F.coalesce(temporal_day(F.col("occurrence_day")), unknown).alias("occurrence_time"), values.alias("financial_values"), ranges.alias("disclosed_ranges"), present(F.when(F.col("ticker_hint").isNotNull(), text_attribute("ticker_hint", F.col("ticker_hint"))), text_attribute("fact_hash", F.col("fact_hash"))).alias("attributes"), F.array("event_evidence_id").alias("event_evidence_ids"), "provenance_id")
    evidence = rows.select("event_evidence_id", "event_id", F.array("source_observation_id").alias("source_observation_ids"), "provenance_id")
    mappings = facts.filter("defect IS NOT NULL OR reason IS NOT NULL").select("source_observation_id", F.col("row_index").cast("string").alias("coordinate"), F.coalesce("defect", "reason").alias("reason"))
    return {"provenance": provenance_of(observed, "normalization", version), "events": conform(events, "events"), "event_evidence": conform(evidence, "event_evidence"), "mappings": mappings}


def evidence_claims(spark, content: bytes, digest: str, spans: list[dict], observed: DataFrame, version: str = "evidence/1.0.0") -> DataFrame:
    """Identifier claims that stand at stated places of a recorded document, whose bytes must have the stated hash.

    Each span has start, end, text, subject_type, subject_id, identifier_type and known_day; the bytes there
    must be the text. The days say when a claim was known, to the day; no listing is made of them.
    """
    import hashlib

    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError("the document is not the one that was reviewed")
    wrong = [s["text"] for s in spans if content[s["start"] : s["end"]] != s["text"].encode()]
    if wrong:
        raise ValueError(f"{wrong[0]!r} does not stand where it is said to")
    rows = spark.createDataFrame([(s["subject_type"], s["subject_id"], s["identifier_type"], s["text"], s["known_day"]) for s in spans], "subject_type string, subject_id string, identifier_type string, value string, known_day string")
    rows = rows.crossJoin(F.broadcast(observed.filter(F.col("raw_sha256") == digest).select("source_observation_id", "observed_at").limit(1)))
    rows = rows.withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version))).withColumn("known_from", temporal_day(F.to_date("known_day"), F.col("known_day")))
    rows = rows.withColumn("external_identifier_id", made_id("claim", F.col("subject_id"), F.col("identifier_type"), F.col("value"), F.col("source_observation_id")))
    return conform(rows, "external_identifiers")


def synthetic_records(rows: DataFrame, observed: DataFrame, version: str = "synthetic/1.0.0") -> dict[str, DataFrame]:
    """Datasets from invented rows (name, public_day, amount, source_observation_id): an end-to-end proof that needs no source."""
    rows = rows.withColumn("event_id", made_id("synthetic-event", F.col("name"))).withColumn("event_evidence_id", made_id("evidence", F.col("event_id"), F.col("source_observation_id"))).withColumn("provenance_id", made_id("provenance", F.col("source_observation_id"), F.lit(version)))
    events = rows.select("event_id", F.lit("synthetic_event").alias("event_type"), temporal_day(F.col("public_day")).alias("occurrence_time"), temporal_day(F.col("public_day")).alias("public_time"), present(F.when(F.col("amount").isNotNull(), money_value("invented_amount", F.col("amount")))).alias("financial_values"), F.array("event_evidence_id").alias("event_evidence_ids"), "provenance_id")
    evidence = rows.select("event_evidence_id", "event_id", F.array("source_observation_id").alias("source_observation_ids"), "provenance_id")
    return {"source_observations": observed, "provenance": provenance_of(observed, "synthetic_test", version), "events": conform(events, "events"), "event_evidence": conform(evidence, "event_evidence")}


def persist(store, records: dict[str, DataFrame]) -> dict[str, bool]:
    """Upserts all datasets in the order of their references, after a check of all that none of them conflicts."""
    from .store import ConflictError, classify

    order = [n for n in DATASETS if n in records]
    for name in order:
        key = DATASETS[name].key
        payload = F.xxhash64(F.to_json(F.struct(*(f for f in DATASETS[name].schema.fieldNames() if f != key))))
        clash = classify(store.load(name), records[name], key, payload).filter("action = 'conflict'").take(1)
        if clash:
            raise ConflictError(f"{name} {clash[0][0]} has another payload; nothing was written")
    return {name: store.persist(name, records[name]) for name in order}
