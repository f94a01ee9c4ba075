"""Bitemporal expressions: coarse bounds, eligibility, availability, partial dates and local clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, DAY, MONTH, YEAR, UNKNOWN = "second", "day", "month", "year", "unknown"


def conservative_start(value: Column) -> Column:
    """When a (precision, year, month, day, timestamp) value is surely over: the first instant after a coarse period."""
    y, m, d, p = value["year"], value["month"], value["day"], value["precision"]
    return (
        F.when(p.isin("second", "minute"), value["timestamp"])
        .when(p == DAY, F.date_add(F.make_date(y, m, d), 1).cast("timestamp"))
        .when(p == MONTH, F.add_months(F.make_date(y, m, F.lit(1)), 1).cast("timestamp"))
        .when(p == YEAR, F.make_date(y + 1, F.lit(1), F.lit(1)).cast("timestamp"))
    )


def conservative_end(value: Column) -> Column:
    """When a value may already have ended: the first instant of a coarse period."""
    p = value["precision"]
    first = F.make_date(value["year"], F.coalesce(value["month"], F.lit(1)), F.coalesce(value["day"], F.lit(1))).cast("timestamp")
    return F.when(p.isin("second", "minute"), value["timestamp"]).when(p.isin(DAY, MONTH, YEAR), first)


def eligibility(snapshot: Column, known_from: Column, known_to: Column, valid_at: Column | None = None, valid_from: Column | None = None, valid_to: Column | None = None) -> Column:
    """Why a record may or may not be used at a snapshot; intervals are half-open, and an unusable bound never passes."""
    start, end = conservative_start(known_from), conservative_end(known_to)
    out = (
        F.when(known_from.isNull(), "missing_known_from")
        .when(start.isNull(), "unsupported_known_precision")
        .when(snapshot < start, "known_after_snapshot")
        .when(known_to.isNotNull() & end.isNull(), "unsupported_known_precision")
        .when(known_to.isNotNull() & (snapshot >= end), "known_interval_ended")
    )
    if valid_at is not None:
        if valid_from is not None:
            low = conservative_start(valid_from)
            out = out.when(valid_from.isNotNull() & (low.isNull() | (valid_at < low)), "outside_valid_interval")
        if valid_to is not None:
            high = conservative_end(valid_to)
            out = out.when(valid_to.isNotNull() & (high.isNull() | (valid_at >= high)), "outside_valid_interval")
    return out.otherwise("eligible")


def availability(precision: Column, delay_seconds: Column) -> Column:
    """How an availability policy can use a public time: exact with any delay, days without one, nothing coarser."""
    return F.when(precision.isin("second", "minute"), "exact").when((precision == DAY) & (delay_seconds == 0), "date_only").otherwise("unsupported")


def available(value: Column, delay_seconds: Column) -> Column:
    """(status, instant, day, defect) of a public time under a policy; a delay on anything but an exact time is a defect."""
    status = availability(value["precision"], delay_seconds)
    exact = value["precision"].isin("second", "minute")
    instant = F.when(exact, F.timestamp_seconds(F.unix_timestamp(value["timestamp"]) + delay_seconds))
    day = F.when(status == "date_only", F.make_date(value["year"], value["month"], value["day"]))
    return F.struct(status.alias("status"), instant.alias("instant"), day.alias("day"), F.when(~exact & (delay_seconds > 0), "delay_on_coarse_time").alias("defect"))


def normalized_utc(raw: Column) -> Column:
    """A timestamp from a text with an offset; null for a naive one, which has no place in time."""
    return F.when(raw.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(raw))


def partial_date(raw: Column) -> Column:
    """YYYY[-MM[-DD]] with 00 for missing parts; null where it can't be one."""
    pattern = r"^([12][0-9]{3}|3000)(?:-([0-9]{2})(?:-([0-9]{2}))?)?$"
    part = lambda i: F.nullif(F.regexp_extract(raw, pattern, i).try_cast("int"), F.lit(0))
    y, m, d = part(1), part(2), part(3)
    precision = F.when(d.isNotNull(), DAY).when(m.isNotNull(), MONTH).otherwise(YEAR)
    sound = raw.rlike(pattern) & ~(m.isNull() & d.isNotNull()) & F.coalesce(m <= 12, F.lit(True))
    real = F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date").isNotNull() | d.isNull()
    return F.when(sound & real, F.struct(raw.alias("raw_value"), precision.alias("precision"), y.alias("year"), m.alias("month"), d.alias("day"), F.lit(None).cast("timestamp").alias("timestamp")))


def local_to_utc(raw: Column, zone: str = "America/New_York") -> Column:
    """yyyyMMddHHmmss in a zone -> UTC; null where the wall clock did not exist or was ambiguous."""
    local = F.try_to_timestamp(raw, F.lit("yyyyMMddHHmmss"))
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    same = lambda t: F.from_utc_timestamp(t, zone) == local
    return F.when(raw.rlike("^[0-9]{14}$") & same(utc) & ~same(utc + hour) & ~same(utc - hour), utc)


def calendar_day(value: Column) -> Column:
    return F.coalesce(F.to_date(value["timestamp"]), F.when(value["precision"] == DAY, F.make_date(value["year"], value["month"], value["day"])))
