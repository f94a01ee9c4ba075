"""Joins on the session dimension. It has a few hundred rows a year, so its size is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_session_map(sessions: DataFrame) -> DataFrame:
    """(day, entry_date, entry_ord): the first session after each calendar day, so that the as-of join is an equi-join."""
    after = F.lead("session_date").over(Window.orderBy("session_date"))
    steps = sessions.select("session_date", "ord", after.alias("following")).filter("following IS NOT NULL")
    return steps.select(F.explode(F.sequence("session_date", F.date_sub("following", 1))).alias("day"), F.col("following").alias("entry_date"), (F.col("ord") + 1).alias("entry_ord"))


def next_session_by_day(events: DataFrame, day: Column, sessions: DataFrame) -> DataFrame:
    """Events with the first session after a day that is known to the day; null beyond the calendar."""
    at = next_session_map(sessions)
    return events.join(at, day == at.day, "left").drop("day")


def next_session_by_instant(events: DataFrame, instant: Column, sessions: DataFrame, open_utc: Column) -> DataFrame:
    """Events with the session that opens next after an instant: today's if it opens later, else the following one."""
    at = next_session_map(sessions)
    day = F.to_date(instant)
    today = sessions.select(F.col("session_date").alias("today"), F.col("ord").alias("today_ord"), open_utc.alias("today_open"))
    found = events.join(today, day == F.col("today"), "left").join(at, day == at.day, "left")
    early = instant < F.col("today_open")
    chosen = F.when(early, F.col("today")).otherwise(F.col("entry_date"))
    rank = F.when(early, F.col("today_ord")).otherwise(F.col("entry_ord"))
    return found.withColumn("entry_date", chosen).withColumn("entry_ord", rank).drop("today", "today_ord", "today_open", "day")


def nth_session(events: DataFrame, sessions: DataFrame, ordinal: str = "entry_ord", horizon: str = "horizon", out: str = "exit_date") -> DataFrame:
    """Events with the date of the session ``horizon`` after their entry; the entry is number zero."""
    at = sessions.select(F.col("ord").alias("its_ord"), F.col("session_date").alias(out))
    return events.join(at, F.col(ordinal) + F.col(horizon) == F.col("its_ord"), "left").drop("its_ord")


def with_horizons(events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Every event once for every horizon; none is lost."""
    return events.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))


def open_of(sessions: DataFrame) -> Column:
    """The opening that a session dimension states; its own column where it has one, else 14:30 UTC of the day."""
    if "open_utc" in sessions.columns:
        return F.col("open_utc")
    return F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + 52200)


def previous_completed(events: DataFrame, instant: Column, sessions: DataFrame) -> DataFrame:
    """Events with ``completed_date``: the last session that had closed at an instant; sessions have close_utc."""
    day = F.to_date(instant)
    before = F.lag("session_date").over(Window.orderBy("session_date"))
    upto = F.lead("session_date").over(Window.orderBy("session_date"))
    steps = sessions.select("session_date", "close_utc", before.alias("prior"), F.coalesce(upto, F.date_add("session_date", 30)).alias("following"))
    at = steps.select("session_date", "close_utc", "prior", F.explode(F.sequence("session_date", F.date_sub("following", 1))).alias("its_day"))
    found = events.join(at, day == F.col("its_day"), "left")
    closed = F.col("close_utc") <= instant
    return found.withColumn("completed_date", F.when(closed, F.col("session_date")).otherwise(F.col("prior"))).drop("session_date", "close_utc", "prior", "its_day")
