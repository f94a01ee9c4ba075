"""Resolution of identifiers and listings: resolved, ambiguous, conflict or unresolved, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_identifier(requests: DataFrame, claims: DataFrame, subjects: DataFrame, known: Column, keys: list[str]) -> DataFrame:
    """request_id, outcome, reason and subject_id; ``known`` tests a claim against the request's time."""
    r = requests.alias("r")
    c = claims.alias("c").join(subjects.select(F.col("subject_id").alias("real_subject")), F.col("c.subject_id") == F.col("real_subject"), "left")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    both = r.join(c, on, "left").withColumn("usable", F.col("c.subject_id").isNotNull() & known)
    grouped = both.groupBy("r.request_id").agg(
        F.count("c.subject_id").alias("matches"),
        F.count_if("usable").alias("usable"),
        F.count_distinct(F.when(F.col("usable"), F.col("c.subject_id"))).alias("subjects"),
        F.min(F.when(F.col("usable"), F.col("c.subject_id"))).alias("subject_id"),
        F.count_if(F.col("usable") & F.col("real_subject").isNull()).alias("orphans"),
    )
    outcome = F.when(F.col("usable") == 0, "unresolved").when(F.col("subjects") > 1, "conflict").when(F.col("orphans") > 0, "unresolved").otherwise("resolved")
    reason = F.when(F.col("matches") == 0, "no_match").when(F.col("usable") == 0, "not_known_at_time").when(F.col("subjects") > 1, "multiple_subjects").when(F.col("orphans") > 0, "no_match").otherwise("exact")
    return grouped.select("request_id", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "resolved", F.col("subject_id")).alias("subject_id"))


def resolve_listing(matches: DataFrame, request: str, listing: str, holds: Column, known: Column | None = None) -> DataFrame:
    """One row for each request from its candidate listings; ``holds`` is true, false, or null for unknown.

    A request without a candidate has one row with a null listing. With ``known``, a candidate counts only
    if a claim of it was known at the request's time. A single candidate of unknown validity keeps its id,
    though it is not resolved.
    """
    there = F.col(listing).isNotNull()
    may = there & F.coalesce(holds, F.lit(True))
    claimed = F.coalesce(known, F.lit(False)) if known is not None else F.lit(True)
    sure_one, vague_one = claimed & there & F.coalesce(holds, F.lit(False)), claimed & there & holds.isNull()
    grouped = matches.groupBy(request).agg(F.count_if(may).alias("possible"), F.count_if(sure_one).alias("certain"), F.count_if(vague_one).alias("uncertain"), F.min(F.when(sure_one, F.col(listing))).alias("only"), F.min(F.when(vague_one, F.col(listing))).alias("vague"))
    sure, maybe = F.col("certain"), F.col("uncertain")
    outcome = F.when((sure == 1) & (maybe == 0), "resolved").when((sure + maybe) > 1, "ambiguous").otherwise("unresolved")
    unknown = (F.col("possible") > 0) & (sure + maybe == 0)
    reason = F.when((sure == 1) & (maybe == 0), "exact").when(((sure + maybe) > 1) & (maybe > 0), "coarse_validity").when((sure + maybe) > 1, "multiple_matches").when(maybe == 1, "coarse_validity").when(unknown, "not_known_at_time").otherwise("no_match")
    return grouped.select(request, outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "resolved", F.col("only")).when((sure == 0) & (maybe == 1), F.col("vague")).alias(listing))


def unanimous(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each column's value where all rows of the key agree on it, nulls included; null where they differ."""
    agreed = [F.when(F.count_distinct(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))) == 1, F.first(c)).alias(c) for c in columns]
    return rows.groupBy(key).agg(*agreed)
