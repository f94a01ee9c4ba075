"""Research rows from canonical records: evidence, population, timing, identity, controls and status, in that order.

Every event gives one row for every horizon. What keeps a row from an outcome is its status and reason;
nothing is dropped, and the first cause that applies is the one stated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.checks import require
from . import sessions as session_joins
from .intervals import holds_on


@dataclass
class Records:
    """What rows are assembled from, as DataFrames.

    events: event_id, event_type, issuer_id, security_id, listing_id, public (temporal), actionable_at
    evidence: event_id, observation_ids
    observations: observation_id, family, role, public
    securities: security_id, issuer_id; listings: listing_id, security_id, venue, from_day, to_day, coarse
    bindings: event_id, security_id, listing_id, history_ids; controls: event_id, exclusion_reason, terminal_date
    policies: family, delay_seconds; sessions: session_date, ord, open_utc
    """

    events: DataFrame
    evidence: DataFrame
    observations: DataFrame
    securities: DataFrame
    listings: DataFrame
    bindings: DataFrame
    controls: DataFrame
    policies: DataFrame
    sessions: DataFrame


def supported(events: DataFrame, evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """(event_id, observation_ids, primaries): all observations behind an event, and the primary ones' family and public time.

    Evidence of an observation that is not there raises when it is read.
    """
    one = evidence.select("event_id", F.explode("observation_ids").alias("wanted")).distinct()
    seen = observations.select("observation_id", "family", "role", F.col("public").alias("its_public"))
    both = one.join(seen, F.col("wanted") == F.col("observation_id"), "left")
    both = require(both, F.col("observation_id").isNotNull(), "evidence names an observation that is missing")
    primary = F.when(F.col("role") == "primary_source", F.struct("family", "its_public"))
    found = both.groupBy("event_id").agg(F.array_sort(F.collect_set("wanted")).alias("observation_ids"), F.collect_set(primary).alias("primaries"))
    rows = events.join(found, "event_id", "left")
    return rows.withColumn("observation_ids", F.coalesce("observation_ids", F.array().cast(found.schema["observation_ids"].dataType))).withColumn("primaries", F.coalesce("primaries", F.array().cast(found.schema["primaries"].dataType)))


def population(rows: DataFrame, types: tuple[str, ...], families: tuple[str, ...], first: str, last: str) -> DataFrame:
    """Rows with ``anchors`` (primaries of declared families), ``selection`` and ``reason``."""
    declared = F.array(*map(F.lit, families))
    rows = rows.withColumn("anchors", F.filter("primaries", lambda p: F.array_contains(declared, p["family"])))
    day = temporal.calendar_day(F.col("public"))
    outside = ~F.col("event_type").isin(*types) | (F.size("anchors") == 0)
    inside = (day >= F.to_date(F.lit(first))) & (day <= F.to_date(F.lit(last)))
    selection = F.when(outside, "excluded").when(day.isNull(), "unknown").when(~inside, "excluded").otherwise("selected")
    reason = F.when(outside, "outside_declared_event_population").when(day.isNull(), "sample_period_unknown").when(~inside, "outside_declared_sample_period")
    return rows.withColumn("selection", selection).withColumn("selection_reason", reason)


def policy_instants(rows: DataFrame, policies: DataFrame, sessions: DataFrame) -> DataFrame:
    """(event_id, delay_seconds, defect, instant): when each matching policy makes an event actionable."""
    mine = rows.select("event_id", "public", F.explode("anchors").alias("a")).filter(F.col("a.its_public").eqNullSafe(F.col("public")))
    mine = mine.select("event_id", "public", F.col("a.family").alias("family")).distinct().join(policies, "family")
    exact = F.col("public.precision").isin("second", "minute")
    mine = mine.withColumn("defect", ~exact & (F.col("delay_seconds") > 0))
    known = F.when(exact, F.timestamp_seconds(F.unix_timestamp("public.timestamp") + F.col("delay_seconds")))
    day = F.when(F.col("public.precision") == "day", F.make_date("public.year", "public.month", "public.day"))
    mine = mine.withColumn("known", known).withColumn("day", day)
    by_day = session_joins.next_session_by_day(mine.withColumnRenamed("day", "its_day"), F.col("its_day"), sessions.select("session_date", "ord")).select("event_id", "family", "delay_seconds", "defect", "known", F.col("entry_date").alias("after_day"))
    by_time = session_joins.next_session_by_instant(by_day, F.col("known"), sessions, F.col("open_utc"))
    chosen = F.coalesce(F.when(F.col("known").isNotNull(), F.col("entry_date")), F.col("after_day"))
    opens = sessions.select(F.col("session_date").alias("its_session"), F.col("open_utc").alias("instant"))
    return by_time.withColumn("session", chosen).join(opens, F.col("session") == F.col("its_session"), "left").select("event_id", "delay_seconds", "defect", "instant")


def timing(rows: DataFrame, policies: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """Rows with ``timing_reason``, the first of six; null where the decision time is defensible."""
    each = policy_instants(rows, policies, sessions).join(rows.select("event_id", F.col("actionable_at").alias("declared")), "event_id")
    found = each.groupBy("event_id").agg(F.count("*").alias("policies"), F.bool_or(~F.col("defect") & ~F.col("instant").eqNullSafe(F.col("declared"))).alias("disagrees"), F.bool_or("defect").alias("defects"))
    none = F.lit(None).cast(temporal_of(rows))
    late = temporal.eligibility(F.to_timestamp(F.lit(as_of)), F.col("public"), none) != "eligible"
    reason = (
        F.when(F.col("actionable_at").isNull(), "missing_actionable_time")
        .when(F.col("public").isNull(), "missing_public_time")
        .when(F.coalesce("policies", F.lit(0)) == 0, "missing_matching_source_public_policy")
        .when(F.col("disagrees"), "actionable_time_disagrees_with_declared_policy")
        .when(F.col("defects"), "unsupported_public_precision_or_calendar_for_policy")
        .when(late, "event_public_time_after_analysis_cutoff")
    )
    return rows.join(found, "event_id", "left").withColumn("timing_reason", reason).drop("policies", "disagrees", "defects")


def temporal_of(rows: DataFrame) -> str:
    return rows.schema["public"].dataType.simpleString()


def once(rows: DataFrame, key: str, message: str) -> DataFrame:
    """Rows with a key of their own, by the partitioning that a join on the key needs anyway; a key that comes twice raises."""
    counted = rows.withColumn("times", F.count("*").over(Window.partitionBy(key)))
    return require(counted, F.col(key).isNull() | (F.col("times") == 1), message).drop("times")


def identified(rows: DataFrame, bindings: DataFrame, securities: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows with the reviewed or else their own security and listing, and ``identity_error``."""
    b = bindings.select(F.col("event_id").alias("bound"), F.col("security_id").alias("bound_security"), F.col("listing_id").alias("bound_listing"), "history_ids")
    rows = rows.join(once(b, "bound", "an event has two bindings"), F.col("event_id") == F.col("bound"), "left")
    has = F.col("bound").isNotNull()
    rows = rows.withColumn("use_security", F.when(has, F.col("bound_security")).otherwise(F.col("security_id"))).withColumn("use_listing", F.when(has, F.col("bound_listing")).otherwise(F.col("listing_id")))
    s = securities.select(F.col("security_id").alias("real_security"), F.col("issuer_id").alias("real_issuer"))
    li = listings.select(F.col("listing_id").alias("real_listing"), F.col("security_id").alias("listing_security"), "venue", "from_day", "to_day", "coarse")
    rows = rows.join(s, F.col("use_security") == F.col("real_security"), "left").join(li, F.col("use_listing") == F.col("real_listing"), "left")
    past = listings.select(F.col("listing_id").alias("past_id"), F.col("security_id").alias("past_security"), F.col("venue").alias("past_venue"))
    odd = rows.select("event_id", "real_security", F.col("venue").alias("now_venue"), F.explode("history_ids").alias("past")).join(past, F.col("past") == F.col("past_id"), "left")
    odd = odd.filter(~(F.col("past_security").eqNullSafe(F.col("real_security")) & F.col("past_venue").eqNullSafe(F.col("now_venue")))).select(F.col("event_id").alias("odd_event")).distinct()
    rows = rows.join(odd, F.col("event_id") == F.col("odd_event"), "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    both = F.col("real_security").isNotNull() & F.col("real_listing").isNotNull()
    against = differs("listing_security", "real_security") | differs("issuer_id", "real_issuer") | differs("security_id", "real_security") | differs("listing_id", "real_listing") | F.col("odd_event").isNotNull()
    entry = F.to_date("actionable_at")
    error = (
        F.when(F.col("real_security").isNull() != F.col("real_listing").isNull(), "partial_security_listing_resolution")
        .when(both & against, "contradictory_source_backed_identity_binding")
        .when(both & entry.isNotNull() & F.col("coarse"), "unsupported_source_backed_listing_interval")
        .when(both & entry.isNotNull() & ~holds_on(entry, F.col("from_day"), F.col("to_day")), "entry_outside_source_backed_listing_interval")
    )
    return rows.withColumn("identity_error", error).drop("bound", "bound_security", "bound_listing", "listing_security", "real_issuer", "odd_event", "venue", "coarse", "from_day", "to_day")


def preliminary(rows: DataFrame, controls: DataFrame, diagnostic: bool, benchmark: bool) -> DataFrame:
    """Rows with the status and reason that need no price, null where an outcome has to be computed, and the terminal date."""
    c = once(controls.select(F.col("event_id").alias("controlled"), "exclusion_reason", "terminal_date"), "controlled", "an event has two controls")
    rows = rows.join(c, F.col("event_id") == F.col("controlled"), "left").drop("controlled")
    unresolved = F.col("real_security").isNull() & F.col("real_listing").isNull()
    as_ = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    state = (
        F.when(F.col("identity_error").isNotNull(), as_("rejected", F.col("identity_error")))
        .when(F.col("selection") == "excluded", as_("excluded", F.col("selection_reason")))
        .when(F.col("timing_reason").isNotNull() | (F.col("selection") == "unknown"), as_("rejected", F.coalesce("selection_reason", "timing_reason")))
        .when(F.col("exclusion_reason").isNotNull(), as_("excluded", F.col("exclusion_reason")))
        .when(unresolved, as_("unresolved_security", F.lit("no_source_backed_security_listing_binding")))
    )
    if diagnostic:
        state = state.otherwise(as_("rejected", F.lit("diagnostic_mode_does_not_evaluate_returns")))
    elif not benchmark:
        state = state.otherwise(as_("rejected", F.lit("benchmark_identity_unresolved")))
    return rows.withColumn("state", state).withColumn("pre_status", F.col("state.status")).withColumn("pre_reason", F.col("state.reason")).drop("state")


def assemble(r: Records, *, types: tuple[str, ...], families: tuple[str, ...], period: tuple[str, str], as_of: str, horizons: tuple[int, ...], bars: DataFrame, benchmark: DataFrame | None, coverage: str, diagnostic: bool = False) -> DataFrame:
    """event_id, horizon, selection, timing_reason, status, reason, entry and exit dates, prices."""
    rows = population(supported(r.events, r.evidence, r.observations), types, families, *period)
    rows = identified(timing(rows, r.policies, r.sessions, as_of), r.bindings, r.securities, r.listings)
    rows = preliminary(rows, r.controls, diagnostic, benchmark is not None)
    opens = r.sessions.select(F.col("session_date").alias("entry_date"), F.col("ord").alias("entry_ord"), F.col("open_utc").alias("its_open"))
    rows = rows.join(opens, F.col("actionable_at") == F.col("its_open"), "left").drop("its_open")
    rows = session_joins.nth_session(session_joins.with_horizons(rows, horizons), r.sessions.select("session_date", "ord"))
    rows = both_prices(rows, bars, "real_security", "entry_open", "exit_close")
    if benchmark is not None:
        rows = both_prices(rows, benchmark, None, "benchmark_entry_open", "benchmark_exit_close")
    else:
        rows = rows.withColumn("benchmark_entry_open", F.lit(None).cast("decimal(18,2)")).withColumn("benchmark_exit_close", F.lit(None).cast("decimal(18,2)"))
    last = F.to_date(F.lit(coverage))
    terminal = F.coalesce(F.col("terminal_date") <= F.least("exit_date", last), F.lit(False))
    gone = lambda *c: F.greatest(*(F.col(x).isNull().cast("int") for x in c)) == 1
    status = (
        F.when(F.col("pre_status").isNotNull(), F.col("pre_status"))
        .when(F.col("entry_date").isNull() | F.col("exit_date").isNull(), "rejected")
        .when(F.col("entry_date") > last, "right_censored")
        .when(terminal, "terminal_delisted")
        .when(gone("entry_open", "benchmark_entry_open"), "missing_price")
        .when(F.col("exit_date") > last, "right_censored")
        .when(gone("exit_close", "benchmark_exit_close"), "missing_price")
        .otherwise("complete")
    )
    rows = rows.withColumn("status", status)
    reason = (
        F.when(F.col("pre_status").isNotNull(), F.col("pre_reason"))
        .when(F.col("status") == "rejected", "outcome_engine_identity_price_or_calendar_rejection")
        .when((F.col("status") == "right_censored") & (F.col("entry_date") > last), "entry_session_not_completed_no_outcome_fabricated")
        .when(F.col("status") != "complete", F.col("status"))
    )
    return rows.withColumn("reason", reason).withColumn("timing_eligible", F.col("timing_reason").isNull())


def both_prices(rows: DataFrame, bars: DataFrame, key: str | None, entry: str, exit_: str) -> DataFrame:
    """Rows with a bar's open on the entry day and its close on the exit day, by one join on both days."""
    days = rows.select(F.col(key).alias("k") if key else F.lit(0).alias("k"), "entry_date", "exit_date").distinct()
    b = bars.select(F.col("security_id").alias("k") if key else F.lit(0).alias("k"), "session_date", F.col("open").alias("o"), F.col("close").alias("c"))
    used = days.select("k", F.explode(F.array("entry_date", "exit_date")).alias("session_date")).distinct()
    priced = b.join(used, ["k", "session_date"])
    first = priced.select(F.col("k").alias("k1"), F.col("session_date").alias("d1"), F.col("o").alias(entry))
    last = priced.select(F.col("k").alias("k2"), F.col("session_date").alias("d2"), F.col("c").alias(exit_))
    k = F.col(key) if key else F.lit(0)
    return rows.join(first, (k == F.col("k1")) & (F.col("entry_date") == F.col("d1")), "left").join(last, (k == F.col("k2")) & (F.col("exit_date") == F.col("d2")), "left").drop("k1", "d1", "k2", "d2")


def listing_prices(bars: DataFrame) -> DataFrame:
    """Bars, one for each security, listing and session: equal ones are one, different ones raise when read."""
    same = F.struct("open", "high", "low", "close", "volume")
    one = bars.groupBy("security_id", "listing_id", "session_date").agg(F.count_distinct(same).alias("kinds"), *(F.first(c).alias(c) for c in ("open", "high", "low", "close", "volume", "provider", "feed", "adjustment")))
    return require(one, F.col("kinds") == 1, "two different bars for one listing and session").drop("kinds")


def price_contract(bars: DataFrame, provider: str, feed: str, adjustment: str) -> DataFrame:
    """The same bars; one of another provider, feed or adjustment raises when read."""
    return require(bars, (F.col("provider") == provider) & (F.col("feed") == feed) & (F.col("adjustment") == adjustment), "a bar of another provider, feed or adjustment")


def completed_coverage(sessions: DataFrame, coverage: str, as_of: str) -> str | None:
    """What is wrong with a coverage day: no session, or one that had not closed; None if nothing is."""
    found = sessions.filter(F.col("session_date") == F.to_date(F.lit(coverage))).select((F.col("close_utc") <= F.to_timestamp(F.lit(as_of))).alias("closed")).first()
    return "coverage_is_no_session" if found is None else None if found["closed"] else "coverage_session_not_completed"


def embargo_sessions(sessions: DataFrame, discovery_end: str, validation_start: str) -> int:
    """How many sessions lie between two periods; a study needs one more than its longest horizon."""
    d = F.col("session_date")
    return sessions.filter((d > F.to_date(F.lit(discovery_end))) & (d < F.to_date(F.lit(validation_start)))).count()


def latest_completed(sessions: DataFrame, as_of: Column) -> DataFrame:
    """(session_date): the last session that had closed at an instant."""
    return sessions.filter(F.col("close_utc") <= as_of).agg(F.max("session_date").alias("session_date"))
