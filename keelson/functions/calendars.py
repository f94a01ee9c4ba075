"""Trading sessions: the test calendar, and New York rules with holidays and half days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checks import require


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS session_date")


#: Days of the test calendar.
FIRST, LAST = "1995-01-01", "2002-12-31"


def covered(events: DataFrame, day: Column, first: str = FIRST, last: str = LAST) -> DataFrame:
    """The same events; reading one whose day lies outside of the calendar raises, as it would be censored for want of sessions. A null day stays."""
    inside = day.isNull() | day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    return require(events, inside, f"an event lies outside of the calendar, {first} to {last}")


def simple_sessions(spark: SparkSession, first: str = FIRST, last: str = LAST) -> DataFrame:
    """(session_date, ord): weekdays but 1 January, 4 July and 25 December. A dimension of bounded size."""
    d = F.col("session_date")
    open_day = (F.weekday(d) < 5) & ~F.date_format(d, "MM-dd").isin("01-01", "07-04", "12-25")
    return days(spark, first, last).filter(open_day).withColumn("ord", F.row_number().over(Window.orderBy("session_date")))


def easter(year: int) -> date:
    """Gregorian Easter Sunday, by the anonymous algorithm."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def new_york_holidays(year: int) -> set[date]:
    """Full holidays of the New York exchanges since 1998, observed days included."""
    last_monday = max(d for d in (date(year, 5, 31) - timedelta(k) for k in range(7)) if d.weekday() == 0)
    found = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(2), last_monday, _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    fixed = [date(year, 7, 4), date(year, 12, 25)] + ([date(year, 6, 19)] if year >= 2022 else [])
    for d in fixed:
        found.add(d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d)
    new_year = date(year, 1, 1)
    if new_year.weekday() != 5:
        found.add(new_year + timedelta(1) if new_year.weekday() == 6 else new_year)
    return found


def new_york_half_days(year: int) -> set[date]:
    """Days that close at 13:00: before Independence Day, after Thanksgiving and Christmas Eve, where they are sessions."""
    found = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 7, 3), date(year, 12, 24)}
    return {d for d in found if d.weekday() < 5 and d not in new_york_holidays(year)}


def new_york_sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(session_date, ord, open_utc, close_utc): the regular sessions; days close in UTC by New York's clock."""
    years = range(int(first[:4]), int(last[:4]) + 1)
    closed = spark.createDataFrame([(d,) for y in years for d in sorted(new_york_holidays(y))], "session_date date")
    half = spark.createDataFrame([(d, 13) for y in years for d in sorted(new_york_half_days(y))], "session_date date, hour int")
    found = days(spark, first, last).filter(F.weekday("session_date") < 5).join(closed, "session_date", "left_anti").join(half, "session_date", "left")
    at = lambda h, m: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("session_date").cast("string"), F.format_string("%02d:%02d:00", h, m))), "America/New_York")
    ranked = found.withColumn("ord", F.row_number().over(Window.orderBy("session_date")))
    return ranked.select("session_date", "ord", at(F.lit(9), F.lit(30)).alias("open_utc"), at(F.coalesce("hour", F.lit(16)), F.lit(0)).alias("close_utc"))
