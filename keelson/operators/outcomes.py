"""Forward outcomes: every event and horizon has one row, with a status and, where complete, returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import next_session_by_day, nth_session, with_horizons

STATUSES = ("complete", "excluded", "missing_price", "rejected", "right_censored", "terminal_delisted", "unresolved_security")


def priced(rows: DataFrame, bars: DataFrame, keys: dict[str, str], price: str, out: str) -> DataFrame:
    """``rows`` with one price of a bar as ``out``, null without the bar. ``keys`` names rows' and bars' columns."""
    b = bars.select(*(F.col(v).alias(f"its_{i}") for i, v in enumerate(keys.values())), F.col(price).alias(out))
    return rows.join(b, [F.col(k) == F.col(f"its_{i}") for i, k in enumerate(keys)], "left").drop(*(f"its_{i}" for i in range(len(keys))))


def ppm(x: Column) -> Column:
    return F.round(x * 1e6).cast("bigint")


def return_of(entry: str, exit_: str) -> Column:
    return F.col(exit_).cast("double") / F.col(entry).cast("double") - 1


def return_e15(entry: str, exit_: str) -> Column:
    """The exact return of two prices, in units of 1e-15 and rounded half up: no double is made."""
    ratio = F.col(exit_).cast("decimal(18,2)") / F.col(entry).cast("decimal(18,2)")
    return (F.round(ratio, 15) * F.lit(10**15).cast("decimal(17,0)")).cast("bigint") - F.lit(10**15)


def outcome_rows(events: DataFrame, sessions: DataFrame, bars: DataFrame, benchmark: DataFrame, *, horizons: tuple[int, ...], coverage: str, excluded: Column, unresolved: Column, terminal: Column, rejected: Column | None = None, lag: int = 0) -> DataFrame:
    """event_id, horizon, entry and exit, prices, status and returns in millionths.

    The status is the first that applies: rejected, excluded, unresolved, censored entry, terminal, missing
    entry price, censored exit, missing exit price, complete. ``terminal`` may use exit_date; ``lag``
    moves the entry by as many sessions.
    """
    rows = with_horizons(next_session_by_day(events, F.col("public_date"), sessions), horizons)
    if lag:
        rows = nth_session(rows.drop("entry_date").withColumn("lag", F.lit(lag)), sessions, horizon="lag", out="entry_date").withColumn("entry_ord", F.col("entry_ord") + lag).drop("lag")
    rows = nth_session(rows, sessions)
    for out, day, price in (("entry_open", "entry_date", "open"), ("exit_close", "exit_date", "close")):
        rows = priced(rows, bars, {"security_id": "security_id", day: "session_date"}, price, out)
        rows = priced(rows, benchmark, {day: "session_date"}, price, f"benchmark_{out}")
    last = F.to_date(F.lit(coverage))
    gone = lambda *c: F.greatest(*(F.col(x).isNull().cast("int") for x in c)) == 1
    status = F.when(rejected if rejected is not None else F.lit(False), "rejected").when(excluded, "excluded").when(unresolved, "unresolved_security").when(F.col("entry_date").isNull() | (F.col("entry_date") > last), "right_censored").when(terminal, "terminal_delisted").when(gone("entry_open", "benchmark_entry_open"), "missing_price").when(F.col("exit_date").isNull() | (F.col("exit_date") > last), "right_censored").when(gone("exit_close", "benchmark_exit_close"), "missing_price").otherwise("complete")
    rows = rows.withColumn("status", status)
    done = F.col("status") == "complete"
    own, against = return_of("entry_open", "exit_close"), return_of("benchmark_entry_open", "benchmark_exit_close")
    return rows.withColumn("return_ppm", F.when(done, ppm(own))).withColumn("benchmark_ppm", F.when(done, ppm(against))).withColumn("excess_ppm", F.col("return_ppm") - F.col("benchmark_ppm"))


def costs(gross: Column, *basis_points: int) -> list[Column]:
    """Net returns in millionths after round-trip costs; null stays null."""
    return [(gross - 100 * b).alias(f"net{b}_ppm") for b in basis_points]
