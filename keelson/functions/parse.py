"""Strict parsers: values that do not have the exact shape are null, never guessed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = r"^\$?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"
RANGE = r"^\s*(\$?[0-9][0-9,]*(?:\.[0-9]+)?)\s+-\s+(\$?[0-9][0-9,]*(?:\.[0-9]+)?)\s*$"


def decimal(raw: Column, kind: str = "decimal(38,18)") -> Column:
    """Plain digits with an optional sign and fraction; no exponent, no separators."""
    value = F.trim(raw)
    return F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.try_cast(kind))


def money(raw: Column, kind: str = "decimal(38,18)") -> Column:
    """An amount that may have a dollar sign and whole groups of three digits."""
    value = F.trim(raw)
    return F.when(value.rlike(MONEY), F.regexp_replace(value, "[$,]", "").try_cast(kind))


def disclosed_range(raw: Column, kind: str = "decimal(38,18)") -> Column:
    """(lower, upper) of "$a - $b"; null where a side is not money or the sides are the wrong way round."""
    low, high = (money(F.regexp_extract(raw, RANGE, i), kind) for i in (1, 2))
    return F.when(raw.rlike(RANGE) & (low <= high), F.struct(low.alias("lower"), high.alias("upper")))


def strict_json(raw: Column) -> Column:
    """VARIANT, or null for duplicate keys, NaN or anything that is not JSON."""
    return F.try_parse_json(raw)


#: What a credential's name has in it, when case and separators are gone.
SECRET = "password|passwd|secret|token|apikey|authorization|credential|privatekey|sessionid"


def has_secret_key(raw: Column) -> Column:
    """Whether a key at any depth of a JSON text names a credential, whatever its case and separators, or a URL in it carries one."""
    keys = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    named = F.exists(F.transform(keys, lambda k: F.lower(F.regexp_replace(k, "[-_ ]", ""))), lambda k: k.rlike(SECRET))
    return named | has_secret_url(F.coalesce(raw, F.lit("")))


def has_secret_url(text: Column) -> Column:
    """Whether a URL in a text has user information, or a query field that names a credential."""
    fields = F.regexp_extract_all(text, F.lit(r'[?&]([^=&#\s"]+)='), F.lit(1))
    return text.rlike(r'[A-Za-z][A-Za-z0-9+.-]*://[^/\s"@]+@') | F.exists(F.transform(fields, lambda k: F.lower(F.regexp_replace(k, "[-_ ]", ""))), lambda k: k.rlike(SECRET))


def names_secret(value: object) -> bool:
    """The same for a value of lists and dicts, in the driver."""
    if isinstance(value, dict):
        return any(re.search(SECRET, re.sub("[-_ ]", "", str(k)).lower()) or names_secret(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return any(map(names_secret, value))
    if not isinstance(value, str):
        return False
    fields = re.findall(r"[?&]([^=&#\s]+)=", value)
    return bool(re.search(r"[A-Za-z][A-Za-z0-9+.-]*://[^/\s@]+@", value)) or any(re.search(SECRET, re.sub("[-_ ]", "", f).lower()) for f in fields)


def vendor_day(raw: Column) -> Column:
    """The day of an ISO date, or of the date before the clock of an ISO timestamp; null for any other text."""
    found = F.regexp_extract(F.trim(raw), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[T ][0-9]{2}:[0-9]{2})", 1)
    return F.when(found != "", found.try_cast("date"))


def vendor_clock(raw: Column) -> Column:
    """(precision, timestamp) of a clock with an offset: exact to the second or minute; unknown without an offset or below a second."""
    value = F.trim(raw)
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([Zz]|[+-][0-9]{2}:?[0-9]{2})$"
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[Zz]$", "+00:00"), " ", "T"), r"(T[0-9]{2}:[0-9]{2})([+-])", "$1:00$2")
    at = F.when(value.rlike(shape), F.try_to_timestamp(whole))
    precision = F.when(at.isNull(), "unknown").when(value.rlike(r"[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), "second").otherwise("minute")
    return F.when(raw.isNotNull(), F.struct(precision.alias("precision"), at.alias("timestamp")))


def same_occurrence(a: Column, b: Column) -> Column:
    """Whether two temporal values are the same at the precision they share; unknown ones never are, and other precisions differ."""
    both = a["precision"] == b["precision"]
    parts = F.struct(a["year"], a["month"], a["day"], a["timestamp"]).eqNullSafe(F.struct(b["year"], b["month"], b["day"], b["timestamp"]))
    return F.coalesce(both & (a["precision"] != "unknown") & parts, F.lit(False))


def same_range(a: Column, b: Column) -> Column:
    """Whether two ranges have equal bounds; a range without any bound equals none."""
    some = a["lower"].isNotNull() | a["upper"].isNotNull()
    return F.coalesce(some & a["lower"].eqNullSafe(b["lower"]) & a["upper"].eqNullSafe(b["upper"]), F.lit(False))


def range_defect(raw: Column, amount: Column) -> Column:
    """Why a disclosed range can't stand: its bounds are inverted, or an amount beside it lies outside; null if it can."""
    low, high = (money(F.regexp_extract(raw, RANGE, i)) for i in (1, 2))
    return F.when(low > high, "inverted_range").when((amount < low) | (amount > high), "amount_outside_range")
