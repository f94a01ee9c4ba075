"""What several queries share: parameters, the outcome rows over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendars import covered, simple_sessions
from ..operators import outcomes
from ..operators.lineage import stored
from ..tables import benchmark_bars, daily_bars, order_events

HORIZONS, COVERAGE = (20, 60, 90), "2001-06-29"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that it is checked against."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def study(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...] = HORIZONS, lag: int = 0) -> DataFrame:
    """The outcome rows of all order events; issuers divisible by 997 stand for contradictory identities."""
    bars = stored(daily_bars(spark, sf_dir))
    return outcomes.outcome_rows(
        covered(order_events(spark, sf_dir), F.col("public_date")), simple_sessions(spark), bars, benchmark_bars(bars), horizons=horizons, coverage=COVERAGE, lag=lag,
        excluded=(F.col("event_type") == "other") | (F.col("family") == "5-LOW"),
        unresolved=F.col("security_id").isin(23, 24),
        terminal=(F.col("security_id") == 22) & (F.col("exit_date") >= F.to_date(F.lit("1999-01-04"))),
        rejected=F.col("issuer_id") % 997 == 0,
    )


CAL = """cal AS (SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS ord FROM (SELECT CAST(g AS DATE) AS d FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(g)) WHERE isodow(d) <= 5 AND strftime(d, '%m-%d') NOT IN ('01-01', '07-04', '12-25'))"""
NEXT = """nxt AS (SELECT CAST(g AS DATE) AS day, (SELECT min(d) FROM cal WHERE d > CAST(g AS DATE)) AS entry_date FROM generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2002-12-30', INTERVAL 1 DAY) t(g))"""
EV = """ev AS (SELECT o_orderkey AS event_id, o_custkey AS issuer_id, c_nationkey AS security_id, CAST(o_orderdate AS DATE) AS public_date, CASE o_orderstatus WHEN 'O' THEN 'equity_purchase' WHEN 'F' THEN 'equity_sale' ELSE 'other' END AS event_type, o_orderpriority AS family FROM orders JOIN customer ON o_custkey = c_custkey)"""
BAR = """bar AS (SELECT s_nationkey AS security_id, CAST(l_shipdate AS DATE) AS d, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS open, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS close, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), bench AS (SELECT d, min(open) AS open, max(close) AS close FROM bar GROUP BY d)"""


def study_sql(horizons: tuple[int, ...] = HORIZONS, lag: int = 0, name: str = "st") -> str:
    hs = ", ".join(f"({h})" for h in horizons)
    return f"""{name}_a AS (SELECT ev.*, h.horizon, c.ord + {lag} AS entry_ord FROM ev CROSS JOIN (VALUES {hs}) h(horizon) LEFT JOIN nxt ON ev.public_date = nxt.day LEFT JOIN cal c ON c.d = nxt.entry_date),
{name}_b AS (SELECT a.*, e.d AS entry_date, x.d AS exit_date, b1.open AS entry_open, b2.close AS exit_close, m1.open AS benchmark_entry_open, m2.close AS benchmark_exit_close FROM {name}_a a LEFT JOIN cal e ON e.ord = a.entry_ord LEFT JOIN cal x ON x.ord = a.entry_ord + a.horizon
  LEFT JOIN bar b1 ON b1.security_id = a.security_id AND b1.d = e.d LEFT JOIN bar b2 ON b2.security_id = a.security_id AND b2.d = x.d LEFT JOIN bench m1 ON m1.d = e.d LEFT JOIN bench m2 ON m2.d = x.d),
{name}_c AS (SELECT *, CASE WHEN issuer_id % 997 = 0 THEN 'rejected' WHEN event_type = 'other' OR family = '5-LOW' THEN 'excluded' WHEN security_id IN (23, 24) THEN 'unresolved_security' WHEN entry_date IS NULL OR entry_date > DATE '{COVERAGE}' THEN 'right_censored'
  WHEN security_id = 22 AND exit_date >= DATE '1999-01-04' THEN 'terminal_delisted' WHEN entry_open IS NULL OR benchmark_entry_open IS NULL THEN 'missing_price' WHEN exit_date IS NULL OR exit_date > DATE '{COVERAGE}' THEN 'right_censored' WHEN exit_close IS NULL OR benchmark_exit_close IS NULL THEN 'missing_price' ELSE 'complete' END AS status FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN status = 'complete' THEN CAST(round((CAST(exit_close AS DOUBLE) / CAST(entry_open AS DOUBLE) - 1) * 1e6) AS BIGINT) END AS return_ppm, CASE WHEN status = 'complete' THEN CAST(round((CAST(benchmark_exit_close AS DOUBLE) / CAST(benchmark_entry_open AS DOUBLE) - 1) * 1e6) AS BIGINT) END AS benchmark_ppm FROM {name}_c),
{name} AS (SELECT *, return_ppm - benchmark_ppm AS excess_ppm FROM {name}_d)"""


STUDY = f"WITH {CAL}, {NEXT}, {EV}, {BAR}, {study_sql()}"
STUDY60 = f"WITH {CAL}, {NEXT}, {EV}, {BAR}, {study_sql((60,))}"
