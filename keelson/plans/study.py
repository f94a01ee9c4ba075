"""Queries of the event study: outcomes, reports, arms and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import control
from ..functions import checks
from ..functions.calendars import covered, simple_sessions
from ..operators import inference, lineage, outcomes, reports, sessions
from ..tables import order_events, table
from .common import BAR, CAL, EV, NEXT, STUDY, STUDY60, register, study, study_sql

STATUSES = outcomes.STATUSES
_VALUES = ", ".join(f"('{s}')" for s in STATUSES)


@register(f"{STUDY} SELECT h.horizon, s.status, count(st.event_id) AS n FROM (VALUES (20), (60), (90)) h(horizon) CROSS JOIN (VALUES {_VALUES}) s(status) LEFT JOIN st ON st.horizon = h.horizon AND st.status = s.status GROUP BY 1, 2")
def q01_outcome_status(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(study(spark, d), "horizon", "status", STATUSES)


@register(f"{STUDY} SELECT event_id, horizon, status, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, return_ppm, benchmark_ppm, excess_ppm FROM st")
def q02_outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).select("event_id", "horizon", "status", F.col("entry_date").cast("string").alias("entry_date"), F.col("exit_date").cast("string").alias("exit_date"), "return_ppm", "benchmark_ppm", "excess_ppm")


@register(f"""{STUDY}, r AS (SELECT horizon, excess_ppm AS v, row_number() OVER (PARTITION BY horizon ORDER BY excess_ppm) AS k, count(*) OVER (PARTITION BY horizon) AS n FROM st WHERE excess_ppm IS NOT NULL)
SELECT horizon, CAST(max(n) AS BIGINT) AS n, CAST(round(CAST(sum(v) AS DOUBLE) / max(n)) AS BIGINT) AS mean, CAST(max(CASE WHEN k = (n + 1) // 2 THEN v END) + max(CASE WHEN k = n // 2 + 1 THEN v END) AS BIGINT) AS median_x2, min(v) AS low, max(v) AS high,
 max(CASE WHEN k = (n + 9) // 10 THEN v END) AS p10, max(CASE WHEN k = (9 * n + 9) // 10 THEN v END) AS p90, count(*) FILTER (WHERE v > 0) AS positive FROM r GROUP BY horizon""")
def q03_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.distribution(study(spark, d), "horizon", "excess_ppm")


@register(f"{STUDY} SELECT horizon, family, status, count(*) AS n, CAST(3 - grouping(horizon) - grouping(family) - grouping(status) AS INTEGER) AS level FROM st GROUP BY ROLLUP (horizon, family, status)")
def q04_by_source_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return reports.crosstab(study(spark, d), "horizon", "family", "status")


@register(f"""{STUDY} SELECT horizon, count(*) AS all_rows, count(*) FILTER (WHERE status <> 'excluded') AS selected, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS eligible, count(*) FILTER (WHERE status = 'complete') AS complete,
 CAST(round(1e6 * count(*) FILTER (WHERE status = 'complete') / nullif(count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')), 0)) AS BIGINT) AS coverage_ppm, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS issuers FROM st GROUP BY horizon""")
def q05_denominators(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    done, fit = F.count_if(s == "complete"), F.count_if(~s.isin("excluded", "rejected"))
    return study(spark, d).groupBy("horizon").agg(F.count("*").alias("all_rows"), F.count_if(s != "excluded").alias("selected"), fit.alias("eligible"), done.alias("complete"), F.round(1e6 * F.try_divide(done, fit)).cast("bigint").alias("coverage_ppm"), F.count_distinct(F.when(s == "complete", F.col("issuer_id"))).alias("issuers"))


@register(f"WITH {CAL}, {NEXT}, {EV} SELECT CAST(entry_date AS VARCHAR) AS entry_date, count(*) AS n FROM ev LEFT JOIN nxt ON public_date = day GROUP BY 1")
def q10_next_session_day(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.next_session_by_day(covered(order_events(spark, d), F.col("public_date")), F.col("public_date"), simple_sessions(spark))
    return found.groupBy(F.col("entry_date").cast("string").alias("entry_date")).agg(F.count("*").alias("n"))


@register(f"WITH {CAL}, {NEXT}, {EV}, n AS (SELECT event_id, h.horizon, c.ord FROM ev CROSS JOIN (VALUES (5), (20), (60), (90), (120)) h(horizon) LEFT JOIN nxt ON public_date = day LEFT JOIN cal c ON c.d = entry_date) SELECT horizon, CAST(x.d AS VARCHAR) AS exit_date, count(*) AS n FROM n LEFT JOIN cal x ON x.ord = n.ord + horizon GROUP BY 1, 2")
def q11_nth_session(spark: SparkSession, d: str) -> DataFrame:
    cal = simple_sessions(spark)
    found = sessions.next_session_by_day(covered(order_events(spark, d), F.col("public_date")), F.col("public_date"), cal)
    found = sessions.nth_session(sessions.with_horizons(found, (5, 20, 60, 90, 120)), cal)
    return found.groupBy("horizon", F.col("exit_date").cast("string").alias("exit_date")).agg(F.count("*").alias("n"))


@register(f"WITH {CAL}, {NEXT}, {EV} SELECT DISTINCT CAST(public_date AS VARCHAR) AS public_date, CAST(e.d AS VARCHAR) AS entry_date, CAST(x.d AS VARCHAR) AS exit_date FROM ev LEFT JOIN nxt ON public_date = day LEFT JOIN cal e ON e.d = entry_date LEFT JOIN cal x ON x.ord = e.ord + 60")
def q32_potential_interval(spark: SparkSession, d: str) -> DataFrame:
    cal = simple_sessions(spark)
    days = sessions.with_horizons(order_events(spark, d).select("public_date").distinct(), (60,))
    found = sessions.nth_session(sessions.next_session_by_day(days, F.col("public_date"), cal), cal)
    return found.select(*(F.col(c).cast("string").alias(c) for c in ("public_date", "entry_date", "exit_date")))


@register(f"WITH {EV}, c AS (SELECT security_id, issuer_id, count(*) AS c FROM ev GROUP BY 1, 2) SELECT security_id, CAST(sum(c) AS BIGINT) AS rows, count(*) AS owners, max(c) AS largest FROM c GROUP BY 1")
def q25_issuer_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.largest_share(order_events(spark, d), "security_id", "issuer_id")


_ARM = "CASE event_type WHEN 'equity_purchase' THEN 'purchase' WHEN 'equity_sale' THEN 'sale' END"


def arms(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "equity_purchase", "purchase").when(F.col("event_type") == "equity_sale", "sale")
    return rows.withColumn("arm", kind).filter("arm IS NOT NULL")


@register(f"""{STUDY}, a AS (SELECT *, {_ARM} AS arm FROM st WHERE {_ARM} IS NOT NULL), i AS (SELECT horizon, arm, max(c) AS largest FROM (SELECT horizon, arm, issuer_id, count(*) AS c FROM a WHERE status = 'complete' GROUP BY ALL) GROUP BY ALL)
SELECT a.horizon, a.arm, count(*) FILTER (WHERE status <> 'excluded') AS selected, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS actionable, count(*) FILTER (WHERE status = 'complete') AS complete, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS issuers, CAST(sum(excess_ppm) AS BIGINT) AS gross_sum,
 CAST(sum(excess_ppm - 1000) AS BIGINT) AS net10_sum, CAST(sum(excess_ppm - 2500) AS BIGINT) AS net25_sum, CAST(sum(excess_ppm - 5000) AS BIGINT) AS net50_sum, any_value(largest) AS largest FROM a LEFT JOIN i ON a.horizon = i.horizon AND a.arm = i.arm GROUP BY 1, 2""")
def q26_arm_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = arms(study(spark, d)).select("*", *outcomes.costs(F.col("excess_ppm"), 10, 25, 50))
    s = F.col("status")
    one = rows.groupBy("horizon", "arm", "issuer_id").agg(F.count_if(s != "excluded").alias("a"), F.count_if(~s.isin("excluded", "rejected")).alias("b"), F.count_if(s == "complete").alias("c"), *(F.sum(x).alias(x) for x in ("excess_ppm", "net10_ppm", "net25_ppm", "net50_ppm")))
    return one.groupBy("horizon", "arm").agg(F.sum("a").alias("selected"), F.sum("b").alias("actionable"), F.sum("c").alias("complete"), F.count_if(F.col("c") > 0).alias("issuers"), F.sum("excess_ppm").alias("gross_sum"), F.sum("net10_ppm").alias("net10_sum"), F.sum("net25_ppm").alias("net25_sum"), F.sum("net50_ppm").alias("net50_sum"), F.nullif(F.max("c"), F.lit(0)).alias("largest"))


_CLUSTERS = """cl AS (SELECT issuer_id, count(*) FILTER (WHERE event_type = 'equity_purchase') AS p_n, CAST(coalesce(sum(excess_ppm) FILTER (WHERE event_type = 'equity_purchase'), 0) AS BIGINT) AS p_sum, count(*) FILTER (WHERE event_type = 'equity_sale') AS s_n, CAST(coalesce(sum(excess_ppm) FILTER (WHERE event_type = 'equity_sale'), 0) AS BIGINT) AS s_sum FROM st WHERE status = 'complete' GROUP BY issuer_id),
ci AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY issuer_id) - 1 AS INTEGER) AS idx FROM cl WHERE p_n + s_n > 0)"""


def issuer_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = study(spark, d, (60,)).filter("status = 'complete'")
    return inference.clusters(rows, "issuer_id", F.col("event_type") == "equity_purchase", F.col("event_type") == "equity_sale", "excess_ppm")


@register(f"{STUDY60}, {_CLUSTERS} SELECT idx, issuer_id, p_n, p_sum, s_n, s_sum FROM ci")
def q27_clusters(spark: SparkSession, d: str) -> DataFrame:
    return issuer_clusters(spark, d).select("idx", "issuer_id", "p_n", "p_sum", "s_n", "s_sum")


@register(f"{STUDY60}, {_CLUSTERS} SELECT CAST(round(CAST(sum(p_sum) AS DOUBLE) / nullif(sum(p_n), 0) - CAST(sum(s_sum) AS DOUBLE) / nullif(sum(s_n), 0)) AS BIGINT) AS contrast_ppm FROM ci")
def q28_contrast(spark: SparkSession, d: str) -> DataFrame:
    return inference.contrast(issuer_clusters(spark, d)).select(F.round("contrast").cast("bigint").alias("contrast_ppm"))


DOMAIN, SEED, RESAMPLES = "cluster-draws", inference.FIXED["seed"], inference.FIXED["resamples"]
PLAN = inference.Plan()
_BOOTSTRAP = f"""g AS MATERIALIZED (SELECT count(*) AS n FROM ci),
w AS MATERIALIZED (SELECT i // n AS resample, CAST(('0x' || substr(sha256(encode('{DOMAIN}') || unhex('{SEED:016x}') || unhex(lpad(to_hex(i), 16, '0'))), 1, 16))::UBIGINT % n AS INTEGER) AS idx FROM (SELECT unnest(range({RESAMPLES} * n)) AS i, n FROM g)),
r AS (SELECT resample, sum(p_n) AS pn, sum(p_sum) AS ps, sum(s_n) AS sn, sum(s_sum) AS ss FROM w JOIN ci USING (idx) GROUP BY 1),
c AS MATERIALIZED (SELECT CAST(ps AS DOUBLE) / nullif(pn, 0) - CAST(ss AS DOUBLE) / nullif(sn, 0) AS contrast FROM r),
k AS MATERIALIZED (SELECT contrast, row_number() OVER (ORDER BY contrast) AS k, count(*) OVER () AS n FROM c WHERE contrast IS NOT NULL),
bt AS MATERIALIZED (SELECT (SELECT count(*) FROM c) AS resamples, (SELECT count(*) FROM c WHERE contrast IS NULL) AS missing, max(CASE WHEN k = (n + 39) // 40 THEN contrast END) AS lower, max(CASE WHEN k = (39 * n + 39) // 40 THEN contrast END) AS upper FROM k)"""


@register(f"{STUDY60}, {_CLUSTERS}, {_BOOTSTRAP} SELECT resamples, missing, CAST(round(lower) AS BIGINT) AS lower_ppm, CAST(round(upper) AS BIGINT) AS upper_ppm FROM bt")
def q29_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    groups = lineage.stored(issuer_clusters(spark, d).select("idx", "p_n", "p_sum", "s_n", "s_sum"))
    sums = inference.resampled(groups, DOMAIN, SEED, RESAMPLES)
    return inference.bootstrap(sums).select("resamples", "missing", F.round("lower").cast("bigint").alias("lower_ppm"), F.round("upper").cast("bigint").alias("upper_ppm"))


def analysis_rows(rows: DataFrame) -> DataFrame:
    """Outcome rows with the selection and timing that an analysis asks for."""
    s = F.col("status")
    return rows.withColumn("selection", F.when(s == "excluded", "excluded").otherwise("selected")).withColumn("timing_eligible", s != "rejected")


_REASONS = " ".join(f"""UNION ALL SELECT {i}, '{arm}:{what}' FROM arm_{short} WHERE {test}""" for short, arm, k in (("p", "equity_purchase", 0), ("s", "equity_sale", 3)) for i, what, test in ((k + 1, "complete_events_below_minimum", "complete < 1000"), (k + 2, "complete_issuers_below_minimum", "issuers < 200"), (k + 3, "actionable_coverage_below_minimum_or_undefined", "actionable = 0 OR complete * 10 < actionable * 9")))


@register(f"""{STUDY60}, {_CLUSTERS}, {_BOOTSTRAP},
arm_p AS MATERIALIZED (SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS issuers, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS actionable, sum(excess_ppm) FILTER (WHERE status = 'complete') AS total FROM st WHERE event_type = 'equity_purchase'),
arm_s AS MATERIALIZED (SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS issuers, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS actionable FROM st WHERE event_type = 'equity_sale'),
why AS (SELECT 7 AS i, 'missing_arm_resamples_above_maximum' AS reason FROM bt WHERE missing * 100 > resamples UNION ALL SELECT 8, 'undefined_primary_statistics' FROM bt, arm_p WHERE lower IS NULL OR complete = 0
 UNION ALL SELECT 9, 'contrast_lower_not_strictly_positive' FROM bt WHERE lower <= 0 UNION ALL SELECT 10, 'purchase_net25_not_strictly_positive' FROM arm_p WHERE complete > 0 AND total <= 2500 * complete {_REASONS})
SELECT CASE WHEN min(i) <= 8 THEN 'insufficient' WHEN min(i) IS NOT NULL THEN 'negative' ELSE 'positive' END AS verdict, coalesce(string_agg(reason, ',' ORDER BY i), 'all_proposed_conditions_met_conditional_only') AS reasons FROM why""")
def q30_verdict(spark: SparkSession, d: str) -> DataFrame:
    read = ("horizon", "event_type", "selection", "timing_eligible", "status", "issuer_id", "excess_ppm")
    rows = lineage.stored(analysis_rows(study(spark, d, (60,))).select(*read))
    found = inference.analyze_horizon(rows, "excess_ppm", 1_000_000, 60, PLAN, DOMAIN, by_issuer=False)
    return spark.createDataFrame([(found["verdict"], ",".join(found["reasons"]))], "verdict string, reasons string")


@register(f"{STUDY} SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in STATUSES) + ", count(DISTINCT event_id) AS events, count(DISTINCT security_id) AS securities, count(DISTINCT issuer_id) AS issuers FROM st")
def q41_survivorship(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).agg(F.count("*").alias("rows"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES), F.count_distinct("event_id").alias("events"), F.count_distinct("security_id").alias("securities"), F.count_distinct("issuer_id").alias("issuers"))


@register(f"""{STUDY}, a AS (SELECT horizon, status, count(*) AS n FROM st WHERE event_id % 97 <> 0 AND status <> 'terminal_delisted' GROUP BY ALL), b AS (SELECT horizon, status, count(*) AS n FROM st WHERE status <> 'rejected' GROUP BY ALL)
SELECT coalesce(a.horizon, b.horizon) AS horizon, coalesce(a.status, b.status) AS status, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM a FULL JOIN b ON a.horizon = b.horizon AND a.status = b.status WHERE a.n IS DISTINCT FROM b.n""")
def q42_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A report that was stored without some events and one status, against the same report made anew without another status."""
    rows = study(spark, d).select("event_id", "horizon", "status")
    old = rows.filter("event_id % 97 <> 0 AND status <> 'terminal_delisted'").groupBy("horizon", "status").agg(F.count("*").alias("n"))
    again = rows.filter("status <> 'rejected'").groupBy("horizon", "status").agg(F.count("*").alias("n"))
    return control.verified_result(old, again, ["horizon", "status"])


@register("""WITH b AS (SELECT s_nationkey AS security_id, CAST(l_shipdate AS DATE) AS d, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS o, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS c, max(l_extendedprice) AS h, min(l_extendedprice) AS l FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
x AS (SELECT security_id, o, c, CASE WHEN day(d) % 7 = 0 THEN l ELSE h END AS h, CASE WHEN day(d) % 7 = 0 THEN h ELSE l END AS l FROM b) SELECT security_id, count(*) FILTER (WHERE least(o, h, l, c) > 0 AND h = greatest(o, h, l, c) AND l = least(o, h, l, c)) AS sane, count(*) AS bars FROM x GROUP BY 1""")
def q44_bar_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Bars by the constraint on them; high and low are the wrong way round on some days."""
    order, price = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), F.col("l_extendedprice")
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bars = lines.groupBy(F.col("s_nationkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("d")).agg(F.min_by(price, order).alias("o"), F.max_by(price, order).alias("c"), F.max(price).alias("h"), F.min(price).alias("l"))
    turned = F.day("d") % 7 == 0
    high, low = F.when(turned, F.col("l")).otherwise(F.col("h")), F.when(turned, F.col("h")).otherwise(F.col("l"))
    return bars.groupBy("security_id").agg(F.count_if(checks.bar_sane(F.col("o"), high, low, F.col("c"))).alias("sane"), F.count("*").alias("bars"))


@register(f"WITH {CAL}, {NEXT}, {EV}, {BAR}, {study_sql((60,))}, {study_sql((60,), 1, 'lg')} SELECT st.status AS status, lg.status AS lagged, count(*) AS n FROM st JOIN lg USING (event_id) GROUP BY 1, 2")
def q46_lag_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    now = study(spark, d, (60,)).select("event_id", "status")
    later = study(spark, d, (60,), lag=1).select("event_id", F.col("status").alias("lagged"))
    return now.join(later, "event_id").groupBy("status", "lagged").agg(F.count("*").alias("n"))


@register(f"""{STUDY60}, e AS (SELECT (entry_ord - 1) // 180 AS episode, {_ARM} AS arm, issuer_id, status, excess_ppm FROM st WHERE entry_ord IS NOT NULL AND (entry_ord - 1) % 180 < 60 AND {_ARM} IS NOT NULL),
g AS (SELECT episode, arm, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status NOT IN ('excluded', 'rejected')) AS actionable, count(DISTINCT CASE WHEN status = 'complete' THEN issuer_id END) AS issuers, CAST(coalesce(sum(excess_ppm) FILTER (WHERE status = 'complete'), 0) AS BIGINT) AS total FROM e GROUP BY 1, 2)
SELECT CAST(episode AS INTEGER) AS episode, arm, complete, actionable, issuers, total, complete >= 20 AND issuers >= 10 AND complete * 10 >= actionable * 9 AS usable FROM g""")
def q47_episode_veto(spark: SparkSession, d: str) -> DataFrame:
    return inference.episodes(arms(study(spark, d, (60,))), "excess_ppm")
