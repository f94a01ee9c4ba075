"""Point-in-time features of events: what was known at the decision, with a reason for each that is not available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal

NOT_KNOWN, NO_QUANTITY, NO_DECISION = "unknown_or_not_historically_eligible_not_zero", "canonical_share_quantity_not_available", "no_defensible_decision_time"


def eligible_at(features: Column, snapshot: Column) -> Column:
    """The elements of an array of features whose ``known_from`` lets them be used at a snapshot."""
    return F.filter(features, lambda f: known_by(f["known_from"], snapshot))


def known_by(known_from: Column, snapshot: Column) -> Column:
    start = temporal.conservative_start(known_from)
    return F.coalesce(known_from.isNotNull() & start.isNotNull() & (snapshot >= start), F.lit(False))


def leaked(features: Column, snapshot: Column) -> Column:
    """Sorted ids of the features that were not known at the snapshot."""
    return F.array_sort(F.transform(F.filter(features, lambda f: ~known_by(f["known_from"], snapshot)), lambda f: f["feature_value_id"]))


def guarded(snapshots: DataFrame) -> DataFrame:
    """The same feature snapshots; reading one with a feature that was not known then raises, and names the features."""
    bad = leaked(F.col("features"), F.col("snapshot_at"))
    message = F.concat(F.lit("features not known at the snapshot: "), F.array_join(bad, ", "))
    return snapshots.filter(F.when(F.size(bad) == 0, True).otherwise(F.raise_error(message).cast("boolean")))


def reported_quantity(values: Column, name: str = "transaction_shares", unit: str = "shares") -> Column:
    """The one quantity of a name and unit; null unless there is exactly one."""
    found = F.filter(values, lambda v: (v["name"] == name) & (v["unit"] == unit) & (v["kind"] == "quantity"))
    return F.when(F.size(found) == 1, found[0]["value"])


def relationship_context(events: DataFrame, relationships: DataFrame) -> DataFrame:
    """(event_id, relationships, observation_ids): the relationships that a party of the event is an end of and that may be used at ``actionable_at``.

    Parties are the entities in ``parties``. Both ends of a relationship are looked up by key, so that no
    pair of an event and a relationship is made but where they meet.
    """
    party = events.select("event_id", "actionable_at", F.explode(F.array_distinct("parties")).alias("entity_id"))
    ends = relationships.select("*", F.explode(F.array("source", "target")).alias("end")).filter("end.subject_type = 'entity'").withColumn("end_id", F.col("end.subject_id"))
    met = party.join(ends, F.col("entity_id") == F.col("end_id")).dropDuplicates(["event_id", "relationship_id"])
    at = F.col("actionable_at")
    usable = temporal.eligibility(at, F.col("known_from"), F.col("known_to"), at, F.col("valid_from"), F.col("valid_to")) == "eligible"
    found = met.filter(usable).groupBy("event_id").agg(F.count("*").alias("relationships"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_observation_ids")))).alias("observation_ids"))
    return events.select("event_id").join(found, "event_id", "left")


def features_of(events: DataFrame, relationships: DataFrame, names: tuple[str, ...] = ("event_type", "reported_shares", "known_relationship_context")) -> DataFrame:
    """(event_id, snapshot_at, text, number maps by feature name, unavailable): the features of each event at its decision."""
    context = relationship_context(events, relationships).select("event_id", "relationships")
    rows = events.join(context, "event_id")
    timed = F.col("actionable_at").isNotNull() & F.col("public").isNotNull()
    known = {"event_type": F.col("event_type").cast("string"), "reported_shares": reported_quantity(F.col("financial_values")).cast("string"), "known_relationship_context": F.col("relationships").cast("string")}
    missing = {"event_type": "", "reported_shares": NO_QUANTITY, "known_relationship_context": NOT_KNOWN}
    pairs = lambda value: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(value(n) for n in names))), lambda k, v: v.isNotNull())
    have = pairs(lambda n: F.when(timed, known[n]))
    lack = pairs(lambda n: F.when(~timed, F.lit(NO_DECISION)).when(known[n].isNull(), F.lit(missing[n])))
    return rows.select("event_id", F.col("actionable_at").alias("snapshot_at"), have.alias("features"), lack.alias("unavailable"))
