"""Queries on whole records: assembly of rows, features, integrity, journals, vendor facts and exact returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import records
from ..functions import parse
from ..functions.calendars import simple_sessions
from ..operators import assembly, audits, features, graph, inference, intervals, lineage, sessions
from ..operators.outcomes import return_e15
from ..sources import adapters, readers
from ..tables import benchmark_bars, daily_bars, table
from .common import BAR, CAL, COVERAGE, HORIZONS, NEXT, STUDY60, register, study
from .study import _ARM, arms

OPEN = "INTERVAL 870 MINUTE"
FLAT = "struct<precision:string,year:int,month:int,day:int,timestamp:timestamp>"


def day_value(day: Column, precision: Column | str = "day") -> Column:
    p = F.lit(precision) if isinstance(precision, str) else precision
    value = F.struct(p.alias("precision"), F.year(day).alias("year"), F.when(p != "year", F.month(day)).alias("month"), F.when(p == "day", F.day(day)).alias("day"), F.lit(None).cast("timestamp").alias("timestamp"))
    return F.when(day.isNotNull(), value)


def opens(day: Column) -> Column:
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + 52200)


def timed_sessions(spark: SparkSession) -> DataFrame:
    s = simple_sessions(spark)
    return s.withColumn("open_utc", opens(F.col("session_date"))).withColumn("close_utc", F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + 75600))


FAMILIES, PERIOD, AS_OF = ("AIR", "RAIL", "SHIP", "TRUCK", "FOB"), ("1995-03-01", "2001-03-01"), "2001-02-15 00:00:00"


def assembly_inputs(spark: SparkSession, d: str) -> assembly.Records:
    """Orders as events, their lines as observations, nations as securities with two listings; what can be wrong is so in one order of a few."""
    cal = timed_sessions(spark)
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, n, day = F.col("o_orderkey"), F.col("c_nationkey"), F.col("o_orderdate").cast("date")
    o = o.select(k.alias("event_id"), n.alias("n"), day.alias("order_day"), F.when(F.col("o_orderstatus") == "O", "equity_purchase").when(F.col("o_orderstatus") == "F", "equity_sale").otherwise("other").alias("event_type"))
    e, n = F.col("event_id"), F.col("n")
    o = sessions.next_session_by_day(o, F.col("order_day"), cal.select("session_date", "ord")).select(*o.columns, F.col("entry_date").alias("following"))
    o = o.join(cal.select(F.col("session_date").alias("same")), F.col("order_day") == F.col("same"), "left")
    chosen = F.when(e % 10 == 3, F.coalesce("same", "following")).otherwise(F.col("following"))
    at = F.when(e % 11 != 0, opens(F.date_add(chosen, F.when(e % 13 == 0, 1).otherwise(0))))
    clock = F.timestamp_seconds(F.unix_date("order_day").cast("long") * 86400 + F.when(e % 10 == 2, 54000).otherwise(36000))
    none = lambda kind: F.lit(None).cast(kind)
    exact = F.struct(F.lit("second").alias("precision"), none("int").alias("year"), none("int").alias("month"), none("int").alias("day"), clock.alias("timestamp"))
    public = F.when(e % 10 == 0, day_value(F.col("order_day"), "month")).when(e % 10 == 1, none(FLAT)).when((e % 10).isin(2, 3), exact).otherwise(day_value(F.col("order_day")))
    issuer = n + 1000 + F.when(e % 29 == 0, 1).otherwise(0)
    listing = n * 10 + F.when((e % 37 == 0) | (F.col("order_day") < F.to_date(F.lit("1998-01-01"))), 1).otherwise(2)
    events = o.select("event_id", "event_type", issuer.cast("long").alias("issuer_id"), F.when(e % 19 != 0, n).cast("long").alias("security_id"), F.when((e % 19 != 0) & (e % 23 != 0), listing).cast("long").alias("listing_id"), public.alias("public"), at.alias("actionable_at"), "n")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), F.min("l_quantity").alias("l_quantity"))
    lines = lines.select("event_id", "l_quantity", F.posexplode(F.array("low", "high")).alias("place", "l_partkey")).join(events.select("event_id", "public"), "event_id")
    oid = (e * 10 + F.col("place")).cast("string")
    observations = lines.select(oid.alias("observation_id"), shipmode().alias("family"), F.when(F.col("place") == 0, "primary_source").otherwise("vendor_normalized").alias("role"), F.when(F.col("l_quantity") <= 45, F.col("public")).alias("public"))
    evidence = lines.groupBy("event_id").agg(F.collect_list(oid).alias("observation_ids"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    securities = nations.select(F.col("n").alias("security_id"), (F.col("n") + 1000).alias("issuer_id"))
    change = F.to_date(F.lit("1998-01-01"))
    listings = nations.select("n", F.explode(F.array(F.lit(1), F.lit(2))).alias("s")).select((F.col("n") * 10 + F.col("s")).alias("listing_id"), F.col("n").alias("security_id"), F.when((F.col("n") == 9) & (F.col("s") == 1), "XNAS").otherwise("XNYS").alias("venue"), F.when(F.col("s") == 2, change).alias("from_day"), F.when(F.col("s") == 1, change).alias("to_day"), ((F.col("n") % 12 == 5) & (F.col("s") == 2)).alias("coarse"))
    other = (F.col("n") + F.when(e % 62 == 0, 1).otherwise(0)) % 25
    bindings = events.filter(e % 31 == 0).select("event_id", other.cast("long").alias("security_id"), (other * 10 + 2).cast("long").alias("listing_id"), F.array((other * 10 + 1).cast("long")).alias("history_ids"))
    controls = events.filter((e % 41 == 0) | (e % 43 == 0)).select("event_id", F.when(e % 41 == 0, "manual_review").alias("exclusion_reason"), F.when(e % 43 == 0, F.to_date(F.lit("1999-01-04"))).alias("terminal_date"))
    policies = spark.createDataFrame([("AIR", 0), ("RAIL", 0), ("SHIP", 3600), ("TRUCK", 0), ("MAIL", 0)], "family string, delay_seconds long")
    return assembly.Records(events.drop("n"), evidence, observations, securities, listings, bindings, controls, policies, cal)


MODES = ("AIR", "RAIL", "SHIP", "TRUCK", "FOB", "MAIL", "REG")
_MODE = f"(CAST({list(MODES)} AS VARCHAR[]))[CAST(l_partkey % 7 + 1 AS INTEGER)]"


def shipmode() -> Column:
    return F.element_at(F.array(*map(F.lit, MODES)), (F.col("l_partkey") % 7 + 1).cast("int"))


_ASSEMBLY = f"""WITH {CAL}, {NEXT}, {BAR},
o AS (SELECT o_orderkey AS e, c_nationkey AS n, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'O' THEN 'equity_purchase' WHEN 'F' THEN 'equity_sale' ELSE 'other' END AS kind, {_MODE} AS fam, l_quantity AS q
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
a AS (SELECT o.*, entry_date AS following, s.d AS same, CASE e % 10 WHEN 0 THEN 'month' WHEN 1 THEN NULL WHEN 2 THEN 'second' WHEN 3 THEN 'second' ELSE 'day' END AS p FROM o LEFT JOIN nxt ON o.day = nxt.day LEFT JOIN cal s ON s.d = o.day),
b AS (SELECT *, CASE WHEN e % 10 = 3 THEN coalesce(same, following) ELSE following END AS chosen FROM a),
c AS (SELECT *, CASE WHEN e % 11 <> 0 THEN CAST(chosen + CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END AS DATE) END AS act,
  CASE WHEN p IN ('day', 'second') THEN day END AS pub_day, CASE p WHEN 'day' THEN CAST(day + 1 AS TIMESTAMP) WHEN 'month' THEN CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS TIMESTAMP) WHEN 'second' THEN CAST(day AS TIMESTAMP) + CASE WHEN e % 10 = 2 THEN INTERVAL 15 HOUR ELSE INTERVAL 10 HOUR END END AS usable,
  fam IN ('AIR', 'RAIL', 'SHIP', 'TRUCK', 'FOB') AS declared FROM b),
s AS (SELECT *, CASE WHEN kind = 'other' OR NOT coalesce(declared, false) THEN 'excluded' WHEN pub_day IS NULL THEN 'unknown' WHEN pub_day NOT BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}' THEN 'excluded' ELSE 'selected' END AS selection,
  CASE WHEN kind = 'other' OR NOT coalesce(declared, false) THEN 'outside_declared_event_population' WHEN pub_day IS NULL THEN 'sample_period_unknown' WHEN pub_day NOT BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}' THEN 'outside_declared_sample_period' END AS sreason,
  coalesce(declared AND fam <> 'FOB' AND (q <= 45 OR p IS NULL), false) AS policy, coalesce(fam = 'SHIP' AND p <> 'second', false) AS defect, CASE WHEN p = 'month' THEN NULL ELSE chosen END AS instant FROM c),
t AS (SELECT *, CASE WHEN act IS NULL THEN 'missing_actionable_time' WHEN p IS NULL THEN 'missing_public_time' WHEN NOT policy THEN 'missing_matching_source_public_policy' WHEN NOT defect AND instant IS DISTINCT FROM act THEN 'actionable_time_disagrees_with_declared_policy'
  WHEN defect THEN 'unsupported_public_precision_or_calendar_for_policy' WHEN TIMESTAMP '{AS_OF}' < usable THEN 'event_public_time_after_analysis_cutoff' END AS treason,
  CASE WHEN e % 31 = 0 THEN (n + CASE WHEN e % 62 = 0 THEN 1 ELSE 0 END) % 25 WHEN e % 19 <> 0 THEN n END AS sec, CASE WHEN e % 19 <> 0 THEN n END AS own_sec,
  CASE WHEN e % 19 <> 0 AND e % 23 <> 0 THEN n * 10 + CASE WHEN e % 37 = 0 OR day < DATE '1998-01-01' THEN 1 ELSE 2 END END AS own_list FROM s),
u AS (SELECT *, CASE WHEN e % 31 = 0 THEN sec * 10 + 2 ELSE own_list END AS list FROM t),
i AS (SELECT *, CASE WHEN (sec IS NULL) <> (list IS NULL) THEN 'partial_security_listing_resolution'
  WHEN sec IS NOT NULL AND (e % 29 = 0 AND n + 1001 <> sec + 1000 OR e % 29 <> 0 AND n <> sec OR coalesce(own_sec <> sec, false) OR coalesce(own_list <> list, false) OR e % 31 = 0 AND sec = 9) THEN 'contradictory_source_backed_identity_binding'
  WHEN sec IS NOT NULL AND act IS NOT NULL AND list % 10 = 2 AND sec % 12 = 5 THEN 'unsupported_source_backed_listing_interval'
  WHEN sec IS NOT NULL AND act IS NOT NULL AND (list % 10 = 1 AND act >= DATE '1998-01-01' OR list % 10 = 2 AND act < DATE '1998-01-01') THEN 'entry_outside_source_backed_listing_interval' END AS ierror FROM u),
h AS (SELECT i.*, h.horizon, x.d AS entry_date, z.d AS exit_date, b1.open AS o1, b2.close AS c2, m1.open AS bo, m2.close AS bc FROM i CROSS JOIN (VALUES (20), (60), (90)) h(horizon) LEFT JOIN cal x ON x.d = i.act LEFT JOIN cal z ON z.ord = x.ord + h.horizon
  LEFT JOIN bar b1 ON b1.security_id = i.sec AND b1.d = x.d LEFT JOIN bar b2 ON b2.security_id = i.sec AND b2.d = z.d LEFT JOIN bench m1 ON m1.d = x.d LEFT JOIN bench m2 ON m2.d = z.d),
r AS (SELECT *, CASE WHEN ierror IS NOT NULL THEN 'rejected' WHEN selection = 'excluded' THEN 'excluded' WHEN treason IS NOT NULL OR selection = 'unknown' THEN 'rejected' WHEN e % 41 = 0 THEN 'excluded' WHEN sec IS NULL AND list IS NULL THEN 'unresolved_security'
  WHEN entry_date IS NULL OR exit_date IS NULL THEN 'rejected' WHEN entry_date > DATE '{COVERAGE}' THEN 'right_censored' WHEN e % 43 = 0 AND DATE '1999-01-04' <= least(exit_date, DATE '{COVERAGE}') THEN 'terminal_delisted' WHEN o1 IS NULL OR bo IS NULL THEN 'missing_price'
  WHEN exit_date > DATE '{COVERAGE}' THEN 'right_censored' WHEN c2 IS NULL OR bc IS NULL THEN 'missing_price' ELSE 'complete' END AS status FROM h),
w AS (SELECT *, CASE WHEN ierror IS NOT NULL THEN ierror WHEN selection = 'excluded' THEN sreason WHEN treason IS NOT NULL OR selection = 'unknown' THEN coalesce(sreason, treason) WHEN e % 41 = 0 THEN 'manual_review' WHEN sec IS NULL AND list IS NULL THEN 'no_source_backed_security_listing_binding'
  WHEN status = 'rejected' THEN 'outcome_engine_identity_price_or_calendar_rejection' WHEN status = 'right_censored' AND entry_date > DATE '{COVERAGE}' THEN 'entry_session_not_completed_no_outcome_fabricated' WHEN status <> 'complete' THEN status END AS reason FROM r)"""


def assembled(spark: SparkSession, d: str) -> DataFrame:
    bars = lineage.stored(daily_bars(spark, d))  # four joins read them
    return assembly.assemble(assembly_inputs(spark, d), types=("equity_purchase", "equity_sale"), families=FAMILIES, period=PERIOD, as_of=AS_OF, horizons=HORIZONS, bars=bars, benchmark=benchmark_bars(bars), coverage=COVERAGE)


@register(f"{_ASSEMBLY} SELECT horizon, selection, treason AS timing_reason, status, reason, count(*) AS n FROM w GROUP BY ALL")
def q49_assembly(spark: SparkSession, d: str) -> DataFrame:
    return assembled(spark, d).groupBy("horizon", "selection", "timing_reason", "status", "reason").agg(F.count("*").alias("n"))


@register(f"{_ASSEMBLY} SELECT e AS event_id, ierror AS identity_error, CAST(sec AS BIGINT) AS security_id FROM i WHERE ierror IS NOT NULL")
def q50_identity_errors(spark: SparkSession, d: str) -> DataFrame:
    r = assembly_inputs(spark, d)
    found = assembly.identified(r.events, r.bindings, r.securities, r.listings)
    return found.filter("identity_error IS NOT NULL").select("event_id", "identity_error", F.col("real_security").alias("security_id"))


@register("""WITH e AS (SELECT o_orderkey AS e, o_custkey AS c, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 870 MINUTE END AS tm, l_quantity AS q FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
s AS (SELECT s_suppkey AS s, s_suppkey * 3 AS a, s_suppkey * 7 AS b, CAST(DATE '1996-01-01' + CAST(s_suppkey AS INTEGER) * 10 + 1 AS TIMESTAMP) AS usable, CASE WHEN s_suppkey % 4 = 0 THEN CAST(DATE '1999-01-01' AS TIMESTAMP) END AS gone FROM supplier),
r AS (SELECT e, count(DISTINCT s) AS n FROM e JOIN s ON c IN (a, b) WHERE tm >= usable AND (gone IS NULL OR tm < gone) GROUP BY e)
SELECT e.e AS event_id, CASE WHEN tm IS NOT NULL AND q IS NOT NULL AND e.e % 5 <> 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) END AS shares, CASE WHEN tm IS NOT NULL THEN CAST(n AS VARCHAR) END AS relationships,
 CASE WHEN tm IS NULL THEN 'event_type:no_defensible_decision_time,known_relationship_context:no_defensible_decision_time,reported_shares:no_defensible_decision_time' ELSE concat_ws(',', CASE WHEN n IS NULL THEN 'known_relationship_context:unknown_or_not_historically_eligible_not_zero' END, CASE WHEN q IS NULL OR e.e % 5 = 0 THEN 'reported_shares:canonical_share_quantity_not_available' END) END AS unavailable
 FROM e LEFT JOIN r ON r.e = e.e""")
def q51_features(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("l_quantity"))
    o = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    one = F.struct(F.lit("transaction_shares").alias("name"), F.lit("quantity").alias("kind"), F.col("l_quantity").cast("bigint").alias("value"), F.lit("shares").alias("unit"))
    values = F.when(F.col("l_quantity").isNull(), F.array().cast("array<struct<name:string,kind:string,value:bigint,unit:string>>")).when(k % 5 == 0, F.array(one, one)).otherwise(F.array(one))
    events = o.select(k.alias("event_id"), F.lit("order").alias("event_type"), F.array(F.col("o_custkey").cast("string")).alias("parties"), day_value(day).alias("public"), F.when(k % 11 != 0, opens(day)).alias("actionable_at"), values.alias("financial_values"))
    s = F.col("s_suppkey")
    end = lambda x: F.struct(F.lit("entity").alias("subject_type"), x.cast("string").alias("subject_id"))
    none = F.lit(None).cast(FLAT)
    edges = table(spark, d, "supplier").select(s.alias("relationship_id"), end(s * 3).alias("source"), end(s * 7).alias("target"), day_value(F.date_add(F.to_date(F.lit("1996-01-01")), (s * 10).cast("int"))).alias("known_from"), F.when(s % 4 == 0, day_value(F.to_date(F.lit("1999-01-01")))).alias("known_to"), none.alias("valid_from"), none.alias("valid_to"), F.array(s).alias("source_observation_ids"))
    found = features.features_of(events, edges)
    lacks = F.array_join(F.array_sort(F.transform(F.map_entries("unavailable"), lambda x: F.concat_ws(":", x["key"], x["value"]))), ",")
    return found.select("event_id", F.element_at("features", F.lit("reported_shares")).alias("shares"), F.element_at("features", F.lit("known_relationship_context")).alias("relationships"), lacks.alias("unavailable"))


def canonical(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as events, evidence and provenance, customers as entities; some of what they refer to is not there."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, "o_custkey")
    text = lambda x: x.cast("string")
    actor = F.array(F.struct(text(F.col("o_custkey") + 1).alias("entity_id"), F.lit("owner").alias("role")))
    return {n: adapters.conform(df, n) for n, df in {
        "source_observations": o.filter(k % 50 != 0).select(text(k).alias("source_observation_id")),
        "provenance": o.select(text(k).alias("provenance_id"), F.array(text(k)).alias("source_observation_ids"), F.array(text(k + 2)).alias("parent_provenance_ids")),
        "event_evidence": o.filter(k % 70 != 0).select(text(k).alias("event_evidence_id"), text(k + F.when(k % 90 == 0, 1).otherwise(0)).alias("event_id"), F.array(text(k)).alias("source_observation_ids"), text(k).alias("provenance_id")),
        "events": o.select(text(k).alias("event_id"), text(F.col("o_custkey")).alias("issuer_entity_id"), actor.alias("actors"), F.array(text(k)).alias("event_evidence_ids"), text(k).alias("provenance_id")),
        "entities": table(spark, d, "customer").filter("c_custkey % 10 <> 3").select(text(F.col("c_custkey")).alias("entity_id"), F.lit("1").alias("provenance_id")),
    }.items()}


KEYS = {n: d.key for n, d in records.DATASETS.items()}


@register("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), en AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 10 <> 3),
x AS (SELECT 'missing source_observations of provenance.source_observation_ids' AS problem, count(*) AS n FROM o WHERE k % 50 = 0
 UNION ALL SELECT 'missing provenance of provenance.parent_provenance_ids', count(*) FROM o WHERE k + 2 NOT IN (SELECT k FROM o)
 UNION ALL SELECT 'missing events of event_evidence.event_id', count(*) FROM o WHERE k % 70 <> 0 AND k % 90 = 0 AND k + 1 NOT IN (SELECT k FROM o)
 UNION ALL SELECT 'missing source_observations of event_evidence.source_observation_ids', count(*) FROM o WHERE k % 70 <> 0 AND k % 50 = 0
 UNION ALL SELECT 'missing event_evidence of events.event_evidence_ids', count(*) FROM o WHERE k % 70 = 0
 UNION ALL SELECT 'missing entities of events.issuer_entity_id', count(*) FROM o WHERE c NOT IN (SELECT c FROM en)
 UNION ALL SELECT 'missing entities of events.actors.entity_id', count(*) FROM o WHERE c + 1 NOT IN (SELECT c FROM en)
 UNION ALL SELECT 'missing provenance of entities.provenance_id', count(*) FROM en WHERE 1 NOT IN (SELECT k FROM o)
 UNION ALL SELECT 'evidence of another event', count(*) FROM o WHERE k % 70 <> 0 AND k % 90 = 0) SELECT problem, n FROM x WHERE n > 0""")
def q52_integrity(spark: SparkSession, d: str) -> DataFrame:
    return graph.integrity(canonical(spark, d), KEYS)


@register("WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part), w(node, a) AS (SELECT node, node FROM e UNION ALL SELECT w.node, e.parent FROM w JOIN e ON w.a = e.node WHERE e.parent > 0) SELECT CAST(node AS BIGINT) AS provenance_id, CAST(count(DISTINCT a % 10) AS INTEGER) AS observations FROM w GROUP BY 1")
def q53_support(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    up = F.floor(p / 3).cast("bigint")
    rows = table(spark, d, "part").select(p.alias("provenance_id"), F.when(up > 0, F.array(up)).alias("parent_provenance_ids"), F.array(p % 10).alias("source_observation_ids"))
    return graph.support(rows).select("provenance_id", "observations")


@register("SELECT what, reason, count(*) AS n FROM (SELECT 'origin' AS what, CASE WHEN c_custkey % 9 = 0 THEN 'synthetic_origin' WHEN c_custkey % 7 = 0 THEN 'unverified_origin' END AS reason FROM customer UNION ALL SELECT 'observation', CASE WHEN s_nationkey > 20 THEN 'unreviewed_provider' WHEN s_suppkey % 5 = 0 THEN 'synthetic_role' WHEN s_suppkey % 6 = 0 THEN 'internal_retention' END FROM supplier) WHERE reason IS NOT NULL GROUP BY 1, 2")
def q54_contamination(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    origins = table(spark, d, "customer").select(c.alias("record_id"), F.when(c % 9 == 0, "synthetic").when(c % 7 == 0, "unverified").otherwise("reviewed").alias("origin"))
    seen = table(spark, d, "supplier").select(s.alias("observation_id"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("provider"), F.when(s % 5 == 0, "synthetic").otherwise("primary_source").alias("role"), F.when(s % 6 == 0, "internal").otherwise("public").alias("retention"))
    return graph.contaminated(origins, seen, "validation", tuple(f"p{i}" for i in range(21))).groupBy("what", "reason").agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN 'unattempted' WHEN event_type = 'error' THEN 'failed' ELSE 'captured' END AS state, CASE WHEN event_id % 17 <> 0 OR event_id % 34 = 0 THEN ts END AS tm, CASE WHEN event_id % 17 <> 0 AND event_type <> 'error' AND event_id % 19 <> 0 THEN 'x' END AS sha FROM events),
w AS (SELECT *, max(tm) OVER win AS tried, coalesce(max(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) OVER win, 0) = 1 AS failed FROM r WINDOW win AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT defect, count(*) AS n FROM (SELECT CASE WHEN state = 'captured' AND sha IS NULL THEN 'captured_without_facts' WHEN state = 'unattempted' AND tm IS NOT NULL THEN 'unattempted_with_facts' WHEN tm IS NOT NULL AND failed THEN 'attempt_after_failure' WHEN tm IS NOT NULL AND epoch_us(tm) - epoch_us(tried) < 3600000000 THEN 'attempts_too_close' END AS defect FROM w) WHERE defect IS NOT NULL GROUP BY 1""")
def q55_receipts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    state = F.when(e % 17 == 0, "unattempted").when(F.col("event_type") == "error", "failed").otherwise("captured")
    rows = table(spark, d, "events").select(F.col("user_id").alias("journal"), e.alias("position"), e.alias("request_id"), state.alias("state"), F.when((e % 17 != 0) | (e % 34 == 0), F.col("ts").cast("timestamp")).alias("attempted_at"), "event_type")
    has = (F.col("state") == "captured") & (F.col("request_id") % 19 != 0)
    rows = rows.withColumn("sha256", F.when(has, "x")).withColumn("length", F.when(has, F.lit(1)))
    return audits.receipt_defects(rows, 3600).groupBy("defect").agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus || '|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y') AS key, count(*) AS n FROM orders GROUP BY 1")
def q56_counters(spark: SparkSession, d: str) -> DataFrame:
    return audits.counters(table(spark, d, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy")), "o_orderstatus", "o_orderpriority", "year")


@register("SELECT level, ids, rows, shared FROM (SELECT 'p_brand' AS level, count(DISTINCT p_brand) AS ids, count(*) AS rows FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name), count(*) FROM part) JOIN (SELECT 'p_brand' AS level, count(*) AS shared FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'p_name', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)) USING (level)")
def q57_envelope(spark: SparkSession, d: str) -> DataFrame:
    distinct, shared, _ = audits.envelope_statistics(table(spark, d, "part"), ("p_brand", "p_name"), ("p_brand",), "p_partkey")
    return distinct.join(shared.groupBy("level").agg(F.count("*").alias("its")), "level", "left").select("level", "ids", "rows", F.coalesce("its", F.lit(0)).alias("shared"))


@register("""WITH iv AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders), x AS (SELECT c, greatest(a, DATE '1996-01-01') AS a, least(b, DATE '1998-01-01') AS b FROM iv WHERE greatest(a, DATE '1996-01-01') < least(b, DATE '1998-01-01') UNION ALL SELECT DISTINCT c, DATE '1998-01-01', DATE '1998-01-01' FROM iv),
w AS (SELECT c, a, coalesce(max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '1996-01-01') AS r FROM x) SELECT c AS o_custkey, CAST(r AS VARCHAR) AS gap_start, CAST(a AS VARCHAR) AS gap_end FROM w WHERE r < a""")
def q58_required_coverage(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").select("o_custkey", day.alias("a"), F.date_add(day, 60).alias("b"))
    found = intervals.uncovered(rows, "o_custkey", "a", "b", F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1997-12-31")))
    return found.select("o_custkey", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"))


@register("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders), f AS (SELECT CASE WHEN k % 3 = 0 THEN 'equity_purchase' WHEN k % 3 = 1 THEN 'equity_sale' END AS event_type,
 CASE WHEN k % 17 = 0 THEN 'missing_fields:Party' WHEN k % 13 = 0 THEN 'occurrence_after_report' WHEN k % 19 = 0 THEN 'bad_person_identifier' WHEN k % 7 = 0 THEN 'inverted_range' WHEN k % 11 = 0 AND k % 23 <> 0 THEN 'range_contradicts_amount' END AS defect, k % 23 = 0 AND k % 7 <> 0 AS unread FROM o)
SELECT event_type, defect, CASE WHEN defect IS NULL AND event_type IS NULL THEN 'unsupported_transaction_classification' END AS reason, count(*) AS n, count(*) FILTER (WHERE unread) AS unread FROM f GROUP BY ALL""")
def q59_vendor_facts(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    low = F.concat(F.lit("$"), F.when(k % 7 == 0, "15,000").otherwise("1,001"))
    high = F.concat(F.lit("$"), F.when(k % 7 == 0, "1,001").otherwise("15,000"))
    text = F.when((k % 23 == 0) & (k % 7 != 0), "over a million").otherwise(F.concat_ws(" - ", low, high))
    row = F.struct(F.lit("A. Person").alias("Representative"), F.when(k % 17 != 0, "I").alias("Party"), day.cast("string").alias("TransactionDate"), F.date_add(day, F.when(k % 13 == 0, -5).otherwise(30)).cast("string").alias("ReportDate"), F.when(k % 3 == 0, "Purchase").when(k % 3 == 1, "SALE").otherwise("Exchange").alias("Transaction"), text.alias("Range"), F.when(k % 11 == 0, "2002.0").when(k % 7 == 0, "15000").otherwise("1001").alias("Amount"), F.when(k % 19 == 0, "B12").otherwise("B000123").alias("BioGuideID"), F.lit("9.9").alias("ExcessReturn"))
    bodies = table(spark, d, "orders").select(k.cast("string").alias("path"), F.to_json(F.array(row)).alias("body"))
    facts = adapters.vendor_facts(readers.vendor_rows(bodies, adapters.ENDPOINTS["congress_v1"]["allowed"]), "congress_v1")
    unread = F.count_if(F.array_contains("notes", "range_text_not_parsed"))
    return facts.groupBy("event_type", "defect", "reason").agg(F.count("*").alias("n"), unread.alias("unread"))


@register(f"{STUDY60} SELECT event_id, CAST(((CAST(exit_close * 100 AS HUGEINT) * 2000000000000000 + CAST(entry_open * 100 AS HUGEINT)) // (2 * CAST(entry_open * 100 AS HUGEINT))) - 1000000000000000 AS BIGINT) AS return_e15 FROM st WHERE status = 'complete'")
def q60_exact_returns(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d, (60,)).filter("status = 'complete'").select("event_id", return_e15("entry_open", "exit_close").alias("return_e15"))


_EPISODES = f"""{STUDY60}, e AS (SELECT (entry_ord - 1) // 180 AS episode, {_ARM} AS arm, issuer_id, status, excess_ppm FROM st WHERE entry_ord IS NOT NULL AND (entry_ord - 1) % 180 < 60 AND {_ARM} IS NOT NULL),
g AS (SELECT episode, arm, count(*) FILTER (WHERE status = 'complete') AS c, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS a, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS i, coalesce(sum(excess_ppm) FILTER (WHERE status = 'complete'), 0) AS t FROM e GROUP BY 1, 2),
u AS (SELECT *, c >= 20 AND i >= 10 AND c * 10 >= a * 9 AS usable FROM g)"""


@register(f"""{_EPISODES}, p AS (SELECT CAST(x.t AS DOUBLE) / x.c - CAST(y.t AS DOUBLE) / y.c AS v FROM u x JOIN u y USING (episode) WHERE x.arm = 'purchase' AND y.arm = 'sale' AND x.usable AND y.usable)
SELECT CAST(count(*) AS INTEGER) AS episodes, count(*) >= 12 AS enough, CAST(round(avg(v)) AS BIGINT) AS mean_ppm, count(*) < 12 OR avg(v) <= 0 AS vetoed FROM p""")
def q61_episode_means(spark: SparkSession, d: str) -> DataFrame:
    found = inference.episode_veto(inference.episodes(arms(study(spark, d, (60,))), "excess_ppm"))
    mean = found["mean_contrast"]
    return spark.createDataFrame([(found["episodes"], found["enough"], None if mean is None else round(mean), found["vetoed"])], "episodes int, enough boolean, mean_ppm long, vetoed boolean")


@register("""WITH cal AS (SELECT CAST(g AS DATE) AS d FROM generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY) t(g) WHERE isodow(g) <= 5 AND strftime(g, '%m-%d') NOT IN ('01-01', '12-25'))
SELECT event_id, CAST((SELECT max(d) FROM cal WHERE d + INTERVAL 21 HOUR <= ts) AS VARCHAR) AS completed_date FROM events""")
def q62_previous_session(spark: SparkSession, d: str) -> DataFrame:
    cal = simple_sessions(spark, "2023-12-01", "2024-03-31").withColumn("close_utc", F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + 75600))
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.previous_completed(rows, F.col("ts"), cal).select("event_id", F.col("completed_date").cast("string").alias("completed_date"))


@register("""WITH e AS (SELECT event_id AS k, date_trunc('second', ts) AS t FROM events)
SELECT k AS event_id, CASE WHEN k % 6 = 5 THEN NULL ELSE strftime(t, '%Y-%m-%d') END AS day, CASE k % 6 WHEN 1 THEN 'second' WHEN 4 THEN 'minute' ELSE 'unknown' END AS precision, CASE k % 6 WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(date_trunc('minute', t) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS at FROM e""")
def q63_vendor_dates(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("event_id") % 6, F.date_trunc("second", F.col("ts").cast("timestamp"))
    as_text = lambda f: F.date_format(t, f)
    raw = F.when(k == 0, as_text("yyyy-MM-dd")).when(k == 1, F.concat(as_text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 2, as_text("yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.concat(as_text("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z"))).when(k == 4, F.concat(as_text("yyyy-MM-dd HH:mm"), F.lit("+02:00"))).otherwise(as_text("MM/dd/yyyy"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", parse.vendor_day(F.col("raw")).alias("day"), parse.vendor_clock(F.col("raw")).alias("c"))
    return rows.select("event_id", F.col("day").cast("string").alias("day"), F.col("c.precision").alias("precision"), F.date_format("c.timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("SELECT count(*) AS claims, count(DISTINCT k) AS keys FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def q64_merged_claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("value"))
    nested = c.filter("c_custkey % 2 = 0").groupBy("value").agg(F.collect_list("c_custkey").alias("ids")).select(F.explode("ids").alias("c_custkey"), "value")
    merged = lineage.merged_claims(nested, c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 5 = 0"), key="c_custkey")
    return lineage.appended(merged, c.filter("c_custkey % 7 = 0").select(merged.columns)).agg(F.count("*").alias("claims"), F.count_distinct("c_custkey").alias("keys"))


@register(f"SELECT l_orderkey, bool_and({_MODE} IN ('AIR', 'RAIL', 'MAIL', 'SHIP')) AS allowed FROM lineitem GROUP BY 1")
def q65_subset(spark: SparkSession, d: str) -> DataFrame:
    modes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(shipmode()).alias("modes"))
    return modes.select("l_orderkey", lineage.subset(F.col("modes"), F.array(*map(F.lit, ("AIR", "RAIL", "MAIL", "SHIP")))).alias("allowed"))


@register("""WITH o AS (SELECT o_orderkey AS k FROM orders), x AS (SELECT unnest([CASE WHEN k % 6 = 0 THEN 'listing_needs_security' END, CASE WHEN k % 10 = 0 THEN 'actors' END, CASE WHEN k % 14 = 0 THEN 'names' END, CASE WHEN k % 15 = 0 THEN 'units' END, CASE WHEN k % 21 = 0 THEN 'ranges' END, CASE WHEN k % 22 = 0 THEN 'occurrence_time' END, CASE WHEN k % 33 = 0 THEN 'evidence' END, CASE WHEN k % 35 = 0 THEN 'attributes' END]) AS rule FROM o) SELECT rule, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY 1""")
def q66_record_rules(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    party = F.struct(F.lit("a").alias("entity_id"), F.lit("r").alias("role"))
    value = lambda name, unit: F.struct(F.lit(name).alias("name"), F.lit("quantity").alias("kind"), F.lit(1).cast("decimal(38,18)").alias("value"), F.lit(None).cast("string").alias("currency"), unit.alias("unit"))
    unit = F.when(k % 15 != 0, "shares")
    span = F.struct(F.lit("range").alias("name"), F.lit("x").alias("raw_text"), F.when(k % 21 == 0, 9).otherwise(1).cast("decimal(38,18)").alias("lower_bound"), F.lit(5).cast("decimal(38,18)").alias("upper_bound"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("unit"))
    flag = F.struct(F.lit("flag").alias("name"), F.lit("boolean").alias("value_type"), F.when(k % 35 == 0, "yes").alias("text"), F.lit(None).cast("decimal(38,18)").alias("number"), F.when(k % 35 != 0, True).alias("flag"), F.lit(None).cast("string").alias("raw_value"))
    when = adapters.temporal_day(day)
    broken = F.struct(*(F.col("w")[c].alias(c) if c != "month" else F.lit(None).cast("int").alias(c) for c in ("raw_value", "precision", "year", "month", "day", "timestamp", "source_timezone")))
    rows = table(spark, d, "orders").select(k, k.cast("string").alias("event_id"), F.lit("x").alias("event_type"), F.lit("i").alias("issuer_entity_id"), F.when(k % 6 != 0, "s").alias("security_id"), F.lit("l").alias("listing_id"), F.when(k % 10 == 0, F.array(party, party)).otherwise(F.array(party)).alias("actors"), F.when(k % 14 == 0, F.array(value("shares", unit), value("shares", unit))).otherwise(F.array(value("shares", unit))).alias("financial_values"), F.array(span).alias("disclosed_ranges"), F.array(flag).alias("attributes"), when.alias("w"), F.when(k % 33 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("event_evidence_ids"), F.lit("p").alias("provenance_id"))
    rows = rows.withColumn("occurrence_time", F.when(k % 22 == 0, broken).otherwise(F.col("w")))
    found = records.violations(adapters.conform(rows, "events"), "events")
    return found.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@register("WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 6 <> 0) SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' WHEN a.k % 2 = 0 THEN 'allowed' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1")
def q67_parent_candidate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    parent = c.filter(k % 4 != 0).select(k.alias("k"), F.col("c_nationkey").alias("v"))
    candidate = c.filter(k % 6 != 0).select(k.alias("k"), (F.col("c_nationkey") + F.when(k % 9 == 0, 1).otherwise(0)).alias("v"))
    return lineage.compared(parent, candidate, ["k"], "v", F.col("k") % 2 == 0).groupBy("state").agg(F.count("*").alias("n"))


@register("SELECT o_orderkey AS row_id, CAST(greatest(DATE '1998-06-01', coalesce(CAST(max(l_shipdate) AS DATE), DATE '1998-06-01')) AS VARCHAR) AS derived_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q68_derived_at(spark: SparkSession, d: str) -> DataFrame:
    oid = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")))
    lines = table(spark, d, "lineitem").select("l_orderkey", oid.alias("observation_id"), F.col("l_shipdate").cast("date").alias("observed_at"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")).join(lines.groupBy("l_orderkey").agg(F.collect_list("observation_id").alias("observation_ids")), F.col("row_id") == F.col("l_orderkey"), "left").select("row_id", "observation_ids")
    found = graph.derived_at(rows, lines, F.to_date(F.lit("1998-06-01")))
    return found.select("row_id", F.col("derived_at").cast("string").alias("derived_at"))


@register("SELECT dataset, records FROM (SELECT 'source_observations' AS dataset, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS records FROM orders UNION ALL SELECT 'provenance', count(*) FROM orders UNION ALL SELECT 'event_evidence', count(*) FILTER (WHERE o_orderkey % 70 <> 0) FROM orders UNION ALL SELECT 'events', count(*) FROM orders UNION ALL SELECT 'entities', count(*) FILTER (WHERE c_custkey % 10 <> 3) FROM customer)")
def q69_record_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.record_counts(canonical(spark, d))


@register(f"{_ASSEMBLY} SELECT CAST(min(entry_date) AS VARCHAR) AS first, CAST(max(greatest(entry_date, exit_date)) AS VARCHAR) AS last FROM w WHERE status IN ('complete', 'missing_price', 'right_censored', 'terminal_delisted')")
def q70_inspection_span(spark: SparkSession, d: str) -> DataFrame:
    rows = assembled(spark, d).filter(F.col("status").isin("complete", "missing_price", "right_censored", "terminal_delisted"))
    return graph.inspection_span(rows).select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))
