"""Queries on records: time, identity, lineage, parsing and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, parse, temporal
from ..functions.calendars import simple_sessions
from ..operators import identity, intervals, lineage, reports, sessions
from ..sources import store
from ..sources.readers import exclusion, reference_groups
from ..tables import order_events, table
from .common import EV, register

# --- time


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each customer, known from its first order to a precision that goes by its number."""
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").cast("date").alias("f"))
    rows = table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "f")
    kind = F.element_at(F.array(*map(F.lit, ("day", "month", "year", "unknown"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    value = lambda p, x: F.struct(p.alias("precision"), F.year(x).alias("year"), F.when(p.isin("day", "month"), F.month(x)).alias("month"), F.when(p == "day", F.day(x)).alias("day"), F.lit(None).cast("timestamp").alias("timestamp"))
    known_from = F.when((F.col("c_custkey") % 5 < 4) & F.col("f").isNotNull(), value(F.when(F.col("c_custkey") % 5 < 4, kind), F.col("f")))
    known_to = F.when((F.col("c_custkey") % 7 == 0) & F.col("f").isNotNull(), value(F.lit("year"), F.add_months("f", 24)))
    return rows.select("c_custkey", known_from.alias("known_from"), known_to.alias("known_to"))


_CLAIM = """c AS (SELECT c_custkey, f, CASE WHEN f IS NULL OR c_custkey % 5 = 4 THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END END AS p,
 CASE c_custkey % 5 WHEN 0 THEN CAST(f + INTERVAL 1 DAY AS TIMESTAMP) WHEN 1 THEN CAST(date_trunc('month', f) + INTERVAL 1 MONTH AS TIMESTAMP) WHEN 2 THEN CAST(date_trunc('year', f) + INTERVAL 1 YEAR AS TIMESTAMP) END AS lo,
 CASE WHEN c_custkey % 7 = 0 THEN CAST(date_trunc('year', f + INTERVAL 24 MONTH) AS TIMESTAMP) END AS hi
 FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
SNAPSHOTS = ("1996-01-01", "1997-01-01", "1999-06-30")


@register(f"""WITH {_CLAIM} SELECT CAST(s.s AS VARCHAR) AS snapshot, CASE WHEN p IS NULL THEN 'missing_known_from' WHEN p = 'unknown' THEN 'unsupported_known_precision' WHEN s.s < lo THEN 'known_after_snapshot' WHEN hi IS NOT NULL AND s.s >= hi THEN 'known_interval_ended' ELSE 'eligible' END AS reason, count(*) AS n
 FROM c CROSS JOIN (VALUES (DATE '1996-01-01'), (DATE '1997-01-01'), (DATE '1999-06-30')) s(s) GROUP BY 1, 2""")
def q06_eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).withColumn("snapshot", F.explode(F.array(*map(F.lit, SNAPSHOTS))))
    reason = temporal.eligibility(F.to_timestamp("snapshot"), F.col("known_from"), F.col("known_to"))
    return rows.groupBy("snapshot", reason.alias("reason")).agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y') || '-00-00' WHEN 4 THEN strftime(o_orderdate, '%Y') || '-00-05' ELSE strftime(o_orderdate, '%Y') || '-13' END AS raw FROM orders)
SELECT raw, CASE WHEN k % 6 IN (0, 3) THEN 'year' WHEN k % 6 = 1 THEN 'month' WHEN k % 6 = 2 THEN 'day' END AS precision, CASE WHEN k % 6 IN (0, 3) THEN CAST(CAST(left(raw, 4) AS INTEGER) + 1 AS VARCHAR) || '-01-01' WHEN k % 6 = 1 THEN strftime(CAST(raw || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') WHEN k % 6 = 2 THEN strftime(CAST(raw AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') END AS usable_from, count(*) AS n FROM r GROUP BY ALL""")
def q07_partial_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    y = F.date_format(day, "yyyy")
    raw = F.when(k == 0, y).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, F.concat(y, F.lit("-00-00"))).when(k == 4, F.concat(y, F.lit("-00-05"))).otherwise(F.concat(y, F.lit("-13")))
    rows = table(spark, d, "orders").select(raw.alias("raw")).withColumn("value", temporal.partial_date(F.col("raw")))
    usable = temporal.conservative_start(F.col("value"))
    return rows.groupBy("raw", F.col("value.precision").alias("precision"), F.date_format(usable, "yyyy-MM-dd").alias("usable_from")).agg(F.count("*").alias("n"))


@register("""WITH e AS (SELECT CASE event_id % 4 WHEN 0 THEN 'second' WHEN 1 THEN 'day' WHEN 2 THEN 'month' ELSE 'unknown' END AS precision, CAST(event_id % 3 * 3600 AS BIGINT) AS delay FROM events)
SELECT precision, delay, CASE WHEN precision = 'second' THEN 'exact' WHEN precision = 'day' AND delay = 0 THEN 'date_only' ELSE 'unsupported' END AS status, count(*) AS n FROM e GROUP BY ALL""")
def q08_availability(spark: SparkSession, d: str) -> DataFrame:
    p = F.element_at(F.array(*map(F.lit, ("second", "day", "month", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(p.alias("precision"), (F.col("event_id") % 3 * 3600).alias("delay"))
    return rows.groupBy("precision", "delay", temporal.availability(F.col("precision"), F.col("delay")).alias("status")).agg(F.count("*").alias("n"))


@register("""WITH cal AS (SELECT CAST(g AS DATE) AS d FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY) t(g) WHERE isodow(g) <= 5 AND strftime(g, '%m-%d') <> '01-01')
SELECT event_id, CAST((SELECT min(d) FROM cal WHERE d + INTERVAL 870 MINUTE > ts) AS VARCHAR) AS entry_date FROM events""")
def q09_next_session_exact(spark: SparkSession, d: str) -> DataFrame:
    cal = simple_sessions(spark, "2024-01-01", "2024-03-31").union(spark.sql("SELECT DATE '2023-12-29', 0"))
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    opens = F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + 52200)
    return sessions.next_session_by_instant(rows, F.col("ts"), cal, opens).select("event_id", F.col("entry_date").cast("string").alias("entry_date"))


@register("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 5 WHEN 4 THEN 12 ELSE o_orderkey % 5 END AS h FROM orders), d AS (SELECT d, h, d + INTERVAL (h * 60 + 30) MINUTE AS local FROM o),
b AS (SELECT *, make_date(CAST(year(d) AS INTEGER), 4, 1) AS a1, make_date(CAST(year(d) AS INTEGER), 10, 31) AS o31 FROM d),
c AS (SELECT *, a1 + CAST((7 - isodow(a1)) AS INTEGER) AS spring, o31 - CAST((isodow(o31) % 7) AS INTEGER) AS autumn FROM b)
SELECT strftime(local, '%Y%m%d%H%M%S') AS raw, CASE WHEN d = spring AND h = 2 THEN NULL WHEN d = autumn AND h = 1 THEN NULL WHEN (d > spring OR d = spring AND h > 2) AND (d < autumn OR d = autumn AND h < 1) THEN strftime(local + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(local + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc, count(*) AS n FROM c GROUP BY ALL""")
def q43_crosscheck_dates(spark: SparkSession, d: str) -> DataFrame:
    hour = F.when(F.col("o_orderkey") % 5 == 4, 12).otherwise(F.col("o_orderkey") % 5)
    rows = table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(hour.cast("string"), 2, "0"), F.lit("3000")).alias("raw"))
    return rows.groupBy("raw", F.date_format(temporal.local_to_utc(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc")).agg(F.count("*").alias("n"))


# --- identity


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Three half-open listings for each nation; nation 7 has its last one twice, every fifth one's first change is vague."""
    parts = "array(named_struct('seg', 1, 'a', CAST(NULL AS DATE), 'b', DATE '1997-01-01'), named_struct('seg', 2, 'a', DATE '1997-01-01', 'b', DATE '1999-07-01'), named_struct('seg', 3, 'a', DATE '1999-07-01', 'b', CAST(NULL AS DATE)))"
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("security_id"), F.inline(F.expr(parts)))
    rows = rows.union(rows.filter("security_id = 7 AND seg = 3").withColumn("seg", F.lit(4)))
    return rows.withColumn("listing_id", F.col("security_id") * 10 + F.col("seg"))


_LISTING = """li AS (SELECT n_nationkey AS security_id, seg, a, b, n_nationkey * 10 + seg AS listing_id FROM nation CROSS JOIN (VALUES (1, NULL, DATE '1997-01-01'), (2, DATE '1997-01-01', DATE '1999-07-01'), (3, DATE '1999-07-01', NULL), (4, DATE '1999-07-01', NULL)) v(seg, a, b) WHERE seg < 4 OR n_nationkey = 7)"""


@register(f"WITH {EV}, {_LISTING} SELECT ev.security_id, CAST(listing_id AS INTEGER) AS listing_id, count(*) AS n FROM ev LEFT JOIN li ON ev.security_id = li.security_id AND (a IS NULL OR public_date >= a) AND (b IS NULL OR public_date < b) GROUP BY 1, 2")
def q12_listing_range_join(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.range_join(order_events(spark, d), listings(spark, d), "security_id", "public_date", "a", "b")
    return found.groupBy("security_id", "listing_id").agg(F.count("*").alias("n"))


@register(f"""WITH {EV}, {_LISTING}, m AS (SELECT event_id, listing_id, CASE WHEN ev.security_id % 5 = 0 AND seg <= 2 AND year(public_date) = 1997 THEN NULL ELSE (a IS NULL OR public_date >= a) AND (b IS NULL OR public_date < b) END AS holds FROM ev LEFT JOIN li ON ev.security_id = li.security_id AND ev.security_id <> 3),
g AS (SELECT event_id, count(*) FILTER (WHERE listing_id IS NOT NULL AND holds) AS sure, count(*) FILTER (WHERE listing_id IS NOT NULL AND holds IS NULL) AS maybe FROM m GROUP BY 1)
SELECT CASE WHEN sure = 1 AND maybe = 0 THEN 'resolved' WHEN sure + maybe > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, CASE WHEN sure = 1 AND maybe = 0 THEN 'exact' WHEN sure + maybe > 1 AND maybe > 0 THEN 'coarse_validity' WHEN sure + maybe > 1 THEN 'multiple_matches' WHEN maybe = 1 THEN 'coarse_validity' ELSE 'no_match' END AS reason, count(*) AS n FROM g GROUP BY 1, 2""")
def q13_listing_resolution(spark: SparkSession, d: str) -> DataFrame:
    li = listings(spark, d).filter("security_id <> 3").withColumnRenamed("security_id", "its_security")
    matches = order_events(spark, d).join(li, F.col("security_id") == F.col("its_security"), "left")
    vague = (F.col("security_id") % 5 == 0) & (F.col("seg") <= 2) & (F.year("public_date") == 1997)
    found = identity.resolve_listing(matches, "event_id", "listing_id", intervals.holds_on(F.col("public_date"), F.col("a"), F.col("b"), vague))
    return found.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@register("""WITH cl AS (SELECT lpad(CAST(c_custkey % 1000 AS VARCHAR), 10, '0') AS value, c_custkey AS subject_id, f FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_custkey % 1000 <> 0),
m AS (SELECT s_suppkey, subject_id, f IS NOT NULL AND f <= DATE '1995-03-01' AS ok FROM supplier LEFT JOIN cl ON value = lpad(CAST(s_suppkey * 7 AS VARCHAR), 10, '0')),
g AS (SELECT s_suppkey AS request_id, count(subject_id) AS m, count(*) FILTER (WHERE subject_id IS NOT NULL AND ok) AS u, count(DISTINCT CASE WHEN ok THEN subject_id END) AS s, min(CASE WHEN ok THEN subject_id END) AS one, count(*) FILTER (WHERE ok AND subject_id % 10 = 3) AS o FROM m GROUP BY 1)
SELECT request_id, CASE WHEN u = 0 THEN 'unresolved' WHEN s > 1 THEN 'conflict' WHEN o > 0 THEN 'unresolved' ELSE 'resolved' END AS outcome, CASE WHEN m = 0 THEN 'no_match' WHEN u = 0 THEN 'not_known_at_time' WHEN s > 1 THEN 'multiple_subjects' WHEN o > 0 THEN 'no_match' ELSE 'exact' END AS reason, CASE WHEN u > 0 AND s <= 1 AND o = 0 THEN one END AS subject_id FROM g""")
def q14_identifier_resolution(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").cast("date").alias("f"))
    customer = table(spark, d, "customer")
    claim = customer.join(first, F.col("c_custkey") == F.col("k"), "left").select(ids.registrant_number((F.col("c_custkey") % 1000).cast("string")).alias("value"), F.col("c_custkey").alias("subject_id"), "f").filter("value IS NOT NULL")
    requests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), ids.registrant_number((F.col("s_suppkey") * 7).cast("string")).alias("value"))
    subjects = customer.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("subject_id"))
    known = F.coalesce(F.col("c.f") <= F.to_date(F.lit("1995-03-01")), F.lit(False))
    return identity.resolve_identifier(requests, claim, subjects, known, ["value"])


_IV = "iv AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) AS b FROM orders)"


def order_intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("a"), F.date_add(day, 60).alias("b"))


@register(f"WITH {_IV}, w AS (SELECT o_custkey, a < lag(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS o FROM iv) SELECT o_custkey, count(*) FILTER (WHERE o) AS overlapping, count(*) AS intervals FROM w GROUP BY 1")
def q15_listing_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps_before(order_intervals(spark, d), "o_custkey", "a", "b", "o_orderkey").groupBy("o_custkey").agg(F.count_if("overlapping").alias("overlapping"), F.count("*").alias("intervals"))


@register(f"WITH {_IV}, w AS (SELECT o_custkey, a, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv) SELECT o_custkey, CAST(r AS VARCHAR) AS gap_start, CAST(a AS VARCHAR) AS gap_end FROM w WHERE r < a")
def q16_coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.gaps(order_intervals(spark, d), "o_custkey", "a", "b", "o_orderkey")
    return found.select("o_custkey", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"))


@register("""WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(min(l_shipdate) AS DATE) END AS f FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2),
c AS (SELECT c_custkey, count(*) FILTER (WHERE f + 1 <= DATE '1995-03-01') AS n FROM customer LEFT JOIN s ON c_nationkey = s_nationkey GROUP BY 1) SELECT c_custkey, nullif(n, 0) AS relationships, CASE WHEN n = 0 THEN 'no_known_relationship' END AS reason FROM c""")
def q17_relationship_context(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("f"))
    edges = table(spark, d, "supplier").join(first, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("f")).alias("f"))
    known = F.when(F.col("f").isNotNull(), F.struct(F.lit("day").alias("precision"), F.year("f").alias("year"), F.month("f").alias("month"), F.day("f").alias("day"), F.lit(None).cast("timestamp").alias("timestamp")))
    reason = temporal.eligibility(F.to_timestamp(F.lit("1995-03-01")), F.col("known"), F.lit(None).cast(temporal_type()))
    usable = edges.withColumn("known", known).filter(reason == "eligible").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(usable, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("c_custkey", F.col("n").alias("relationships"), F.when(F.col("n").isNull(), "no_known_relationship").alias("reason"))


def temporal_type() -> str:
    return "struct<precision:string,year:int,month:int,day:int,timestamp:timestamp>"


@register("SELECT c_custkey, CASE WHEN c_custkey > 0 THEN lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) END AS entity_id FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(length('cik') || ':cik' || length(lpad(CAST(c_custkey AS VARCHAR), 10, '0')) || ':' || lpad(CAST(c_custkey AS VARCHAR), 10, '0'))) AS h FROM customer)")
def q40_uuid5(spark: SparkSession, d: str) -> DataFrame:
    name = ids.prefixed(F.lit("cik"), ids.registrant_number(F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", ids.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("entity_id"))


@register("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY 1")
def q45_unanimous(spark: SparkSession, d: str) -> DataFrame:
    return identity.unanimous(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


# --- lineage and integrity


@register("SELECT o_custkey, coalesce(nullif(string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '+' ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), ''), 'unanchored') AS families FROM orders GROUP BY 1")
def q18_primary_families(spark: SparkSession, d: str) -> DataFrame:
    return lineage.families(table(spark, d, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F")


@register("SELECT count(*) AS orphans, count(DISTINCT k) AS keys FROM (SELECT l_partkey * 2 AS k FROM lineitem) WHERE k NOT IN (SELECT p_partkey FROM part)")
def q19_orphans(spark: SparkSession, d: str) -> DataFrame:
    child = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("k"))
    return lineage.orphans(child, "k", table(spark, d, "part"), "p_partkey").agg(F.count("*").alias("orphans"), F.count_distinct("k").alias("keys"))


@register("WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS parent FROM part), w(node, ancestor, steps) AS (SELECT node, node, 0 FROM e UNION ALL SELECT w.node, e.parent, w.steps + 1 FROM w JOIN e ON w.ancestor = e.node WHERE e.parent IS NOT NULL) SELECT CAST(steps AS INTEGER) AS steps, count(*) AS pairs, count(DISTINCT ancestor) AS ancestors FROM w GROUP BY 1")
def q20_provenance_closure(spark: SparkSession, d: str) -> DataFrame:
    parent = F.floor(F.col("p_partkey") / 2).cast("bigint")
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(parent > 0, parent).alias("parent"))
    return lineage.ancestors(spark, edges).groupBy("steps").agg(F.count("*").alias("pairs"), F.count_distinct("ancestor").alias("ancestors"))


@register("WITH a AS (SELECT p_partkey AS k, md5(p_name || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END) AS h FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_partkey % 5 <> 0) SELECT CASE WHEN a.h = b.h THEN 'match' WHEN a.h IS NOT NULL AND b.h IS NOT NULL THEN 'changed' WHEN a.h IS NOT NULL THEN 'missing' ELSE 'undeclared' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def q21_origin_cover(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a = part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(""))).alias("h"))
    b = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("h"))
    return lineage.cover(a, b, ["k"], "h").groupBy("state").agg(F.count("*").alias("n"))


@register("WITH n AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0) SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN n.v = o.v THEN 'no_op' ELSE 'conflict' END AS action, count(*) AS n FROM n LEFT JOIN o USING (k) GROUP BY 1")
def q22_upsert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)).alias("v"))
    return store.classify(old, new, "k", F.to_json(F.struct("k", "v"))).groupBy("action").agg(F.count("*").alias("n"))


@register("WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k, min(event_type) OVER (PARTITION BY user_id) <> max(event_type) OVER (PARTITION BY user_id) AS conflict FROM events) SELECT user_id, event_type, conflict FROM w WHERE k = 1")
def q23_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return store.first_seen(table(spark, d, "events").select("user_id", "event_type", "ts"), "user_id", "ts", ["event_type"]).select("user_id", "event_type", "conflict")


@register("SELECT count(*) FILTER (WHERE c > 1) AS groups, CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS excess FROM (SELECT sha256(text), count(*) AS c FROM documents GROUP BY 1)")
def q24_repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.repeated_excess(table(spark, d, "documents").select(F.sha2("text", 256).alias("fact")), "fact")


@register("SELECT o_orderkey, o_custkey % 50 = 0 AND o_orderstatus IS NOT DISTINCT FROM 'F' OR o_orderstatus = 'O' AND o_custkey % 50 <> 0 AS covered FROM orders")
def q48_manifest_cover(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 50 == 0, F.lit(None)).otherwise(F.lit("p")).alias("provider"), F.col("o_orderstatus").alias("role"))
    manifests = spark.createDataFrame([(None, "F"), ("p", "O")], "provider string, role string")
    return store.manifest_cover(manifests, obs, ["provider", "role"]).select("o_orderkey", "covered")


# --- sweeps, scans and parsing

_SHIP = "sp AS (SELECT c_nationkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey, o_orderkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate)"


@register(f"""WITH {_SHIP}, e AS (SELECT c_nationkey, o_custkey, a AS t, 0 AS kind, 1 AS s FROM sp UNION ALL SELECT c_nationkey, o_custkey, b, 1, -1 FROM sp), g AS (SELECT c_nationkey, o_custkey, t, kind, sum(s) AS s FROM e GROUP BY ALL),
n AS (SELECT *, sum(s) OVER (PARTITION BY c_nationkey, o_custkey ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS n FROM g), q AS (SELECT *, CASE WHEN n - s = 0 AND n > 0 THEN 1 WHEN n - s > 0 AND n = 0 THEN -1 ELSE 0 END AS o FROM n),
h AS (SELECT c_nationkey, t, kind, sum(s) AS s, sum(o) AS o FROM q GROUP BY ALL), r AS (SELECT c_nationkey, sum(s) OVER w AS active, sum(o) OVER w AS owners FROM h WINDOW w AS (PARTITION BY c_nationkey ORDER BY t, kind ROWS UNBOUNDED PRECEDING))
SELECT c_nationkey, CAST(max(active) AS BIGINT) AS peak_active, CAST(max(owners) AS BIGINT) AS peak_owners, CAST(max(active - owners) AS BIGINT) AS peak_repeats FROM r GROUP BY 1""")
def q31_overlap_sweep(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("b"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "o_custkey", F.col("o_orderdate").cast("date").alias("a"), "b").filter("b >= a")
    return intervals.sweep(rows, "a", "b", "o_custkey", "c_nationkey")


@register("""SELECT CASE WHEN l_returnflag = 'R' THEN 'unsupported_form' WHEN l_linestatus = 'F' AND l_linenumber = 4 THEN 'derivative_table' WHEN l_linenumber = 5 THEN 'non_transaction_holding' WHEN l_linenumber NOT IN (1, 2) THEN 'unsupported_code' WHEN l_partkey % 9 = 0 THEN 'unsupported_transaction_form' WHEN l_partkey % 10 = 0 THEN 'missing_transaction_date' END AS exclusion, count(*) AS n FROM lineitem GROUP BY 1""")
def q33_row_exclusions(spark: SparkSession, d: str) -> DataFrame:
    n, key = F.col("l_linenumber"), F.col("l_partkey")
    form = F.when(F.col("l_returnflag") == "R", "5").when(F.col("l_returnflag") == "A", "4/A").otherwise("4")
    kind = F.when((F.col("l_linestatus") == "F") & (n == 4), "derivative").when(n == 5, "holding").otherwise("transaction")
    why = exclusion(form, kind, F.when(n == 1, "P").when(n == 2, "S").otherwise("M"), F.when(key % 9 == 0, "5").otherwise("4"), F.when(key % 10 != 0, F.col("l_shipdate").cast("date")))
    return table(spark, d, "lineitem").groupBy(why.alias("exclusion")).agg(F.count("*").alias("n"))


@register("SELECT event_type, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS kept, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE len(json_keys(props)) > 1) AS quarantined FROM events GROUP BY 1")
def q34_allowlist_json(spark: SparkSession, d: str) -> DataFrame:
    fields = F.from_json("props", "map<string,string>")
    rows = table(spark, d, "events").filter(parse.strict_json(F.col("props")).isNotNull()).select("event_type", F.map_filter(fields, lambda k, v: k == "k").alias("facts"), F.map_filter(fields, lambda k, v: k != "k").alias("rest"))
    return rows.groupBy("event_type").agg(F.count_if(F.size("facts") > 0).alias("kept"), F.sum(F.col("facts")["k"].cast("bigint")).alias("total"), F.count_if(F.size("rest") > 0).alias("quarantined"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS low, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) + 100000 END AS high FROM part")
def q35_money_range(spark: SparkSession, d: str) -> DataFrame:
    price = F.round("p_retailprice", 2).cast("decimal(18,2)")
    text = lambda x: F.concat(F.lit("$"), F.format_number(x, 2))
    low, high = text(price), text(price + 1000)
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("about "), low)).when(F.col("p_partkey") % 7 == 0, F.concat_ws(" - ", high, low)).otherwise(F.concat_ws(" - ", low, high))
    rows = table(spark, d, "part").select("p_partkey", parse.disclosed_range(raw).alias("r"))
    return rows.select("p_partkey", (F.col("r.lower") * 100).cast("bigint").alias("low"), (F.col("r.upper") * 100).cast("bigint").alias("high"))


@register("""WITH r AS (SELECT o_orderkey // 4 AS a, o_custkey AS cik, CASE WHEN o_orderkey % 20 = 0 THEN '4/A' ELSE '4' END AS form, o_orderkey % 3 = 0 AS twice FROM orders), x AS (SELECT a, cik, form FROM r UNION ALL SELECT a, cik, form FROM r WHERE twice)
SELECT CAST(a AS VARCHAR) AS accession, array_to_string(list_sort(list(DISTINCT form)), ',') AS forms, count(DISTINCT (cik, form)) AS literals, count(*) - count(DISTINCT (cik, form)) AS repeats, count(DISTINCT form) > 1 AS conflict, CASE WHEN count(DISTINCT form) = 1 THEN 'f' || CAST(min(cik) AS VARCHAR) END AS locator FROM x GROUP BY a""")
def q36_reference_groups(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of four orders each: some are there twice, and some groups disagree on their form."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rows = table(spark, d, "orders").select(F.floor(k / 4).cast("string").alias("accession"), c.alias("cik"), F.lit("n").alias("company"), F.when(k % 20 == 0, "4/A").otherwise("4").alias("form"), F.lit("2024-01-02").alias("filed"), F.concat(F.lit("f"), c).alias("file_name"), (k % 3 == 0).alias("twice"))
    found = reference_groups(rows.drop("twice").union(rows.filter("twice").drop("twice")))
    return found.select("accession", F.array_join("forms", ",").alias("forms"), "literals", "repeats", "conflict", "locator")


@register("WITH s AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey AS VARCHAR) AS issuer FROM orders), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY issuer) AS INTEGER) AS k FROM s) SELECT month, issuer, k FROM r WHERE k <= 4")
def q37_first_four(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").cast("string").alias("issuer"))
    return reports.first_k(rows, "month", "issuer", 4)


@register("WITH w AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600 AS near, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AS after FROM events) SELECT user_id, count(*) FILTER (WHERE near) AS too_close, count(*) FILTER (WHERE after) AS after_failure, count(*) AS attempts FROM w GROUP BY 1")
def q38_request_spacing(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    near = seconds - F.lag(seconds).over(w) < 3600
    after = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1
    return table(spark, d, "events").select("user_id", near.alias("near"), after.alias("after")).groupBy("user_id").agg(F.count_if("near").alias("too_close"), F.count_if("after").alias("after_failure"), F.count("*").alias("attempts"))


@register(f"WITH {_IV}, m AS (SELECT CAST(g AS DATE) AS c, CAST(g + INTERVAL 20 DAY AS DATE) AS e FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) t(g)) SELECT CAST(c AS VARCHAR) AS window_start, count(*) AS n, count(DISTINCT o_custkey) AS issuers FROM iv JOIN m ON a <= e AND c <= b GROUP BY 1")
def q39_inspection_overlap(spark: SparkSession, d: str) -> DataFrame:
    months = spark.sql("SELECT c, date_add(c, 20) AS e FROM (SELECT explode(sequence(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS c)")
    found = intervals.interval_overlaps(order_intervals(spark, d), months, ("a", "b"), ("c", "e"))
    return found.groupBy(F.col("c").cast("string").alias("window_start")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("issuers"))
