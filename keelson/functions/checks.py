"""Record constraints as boolean columns: true where a row obeys, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def bar_sane(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return sure((F.least(open_, high, low, close) > 0) & (high == F.greatest(open_, high, low, close)) & (low == F.least(open_, high, low, close)))


def outcome_rules() -> dict[str, Column]:
    """Which fields of an outcome its status needs and forbids, by name."""
    c = F.col
    some = lambda *names: F.greatest(*(c(n).isNotNull().cast("int") for n in names)) == 1
    every = lambda *names: F.least(*(c(n).isNotNull().cast("int") for n in names)) == 1
    s, returns = c("status"), ("security_return", "benchmark_return", "excess_return")
    sources = F.coalesce(F.size("methodology.price_source_observation_ids"), F.lit(0)) > 0
    rules = {
        "complete_has_all": (s != "complete") | every("security_id", "listing_id", "entry_at", "exit_at", "entry_price", "exit_price", "benchmark_listing_id", *returns),
        "others_have_no_return": (s == "complete") | ~some(*returns),
        "others_have_no_exit": (s == "complete") | ~some("exit_at", "exit_price"),
        "listing_needs_security": c("listing_id").isNull() | c("security_id").isNotNull(),
        "entry_in_pairs": c("entry_at").isNull() == c("entry_price").isNull(),
        "exit_in_pairs": c("exit_at").isNull() == c("exit_price").isNull(),
        "prices_have_sources": ~some("entry_price", "exit_price") | sources,
        "price_sources_once": unique(F.coalesce("methodology.price_source_observation_ids", F.array().cast("array<string>"))),
        "censored_has_entry": (s != "right_censored") | every("security_id", "listing_id", "entry_at", "entry_price"),
        "unresolved_has_nothing": (s != "unresolved_security") | ~some("security_id", "listing_id", "entry_at", "entry_price", "exit_at", "exit_price"),
        "excluded_has_reason": (s == "excluded") == c("exclusion_reason").isNotNull(),
    }
    return {name: sure(rule) for name, rule in rules.items()}


def financial_units(value: Column) -> Column:
    """Which kinds of value have a currency and a unit."""
    money, unit, kind = value["currency"].isNotNull(), value["unit"].isNotNull(), value["kind"]
    sound = F.coalesce(value["currency"].rlike("^[A-Z]{3}$"), F.lit(True))
    return sure(sound & F.when(kind == "monetary_amount", money & ~unit).when(kind == "unit_price", money & unit).when(kind == "quantity", ~money & unit).when(kind == "percentage", ~money & ~unit).otherwise(False))


def typed_attribute(value: Column) -> Column:
    """An attribute has the one value that its type names: text, a number, a whole number or a flag."""
    text, number, flag, kind = value["text"].isNotNull(), value["number"].isNotNull(), value["flag"].isNotNull(), value["value_type"]
    whole = F.coalesce(value["number"] == F.floor(value["number"]), F.lit(False))
    return sure(F.when(kind.isin("code", "text"), text & ~number & ~flag).when(kind == "boolean", flag & ~text & ~number).when(kind == "integer", whole & ~text & ~flag).when(kind == "decimal", number & ~text & ~flag).otherwise(False))


def availability_coherent(status: Column, public: Column, instant: Column, day: Column) -> Column:
    """An exact availability has an instant, a day one its day, an unsupported one neither."""
    return sure(F.when(status == "exact", public.isNotNull() & instant.isNotNull() & day.isNull()).when(status == "date_only", public.isNotNull() & instant.isNull() & day.isNotNull()).when(status == "unsupported", instant.isNull() & day.isNull()).otherwise(False))


def actionable_coherent(status: Column, session: Column, at: Column) -> Column:
    """A session and its opening are there together, and exactly where the status is not unsupported."""
    return sure((session.isNotNull() == at.isNotNull()) & ((status == "unsupported") == session.isNull()))


def eligibility_coherent(eligible: Column, reason: Column) -> Column:
    return sure(eligible == (reason == "eligible"))


def temporal_value(value: Column) -> Column:
    """Dates have the parts of their precision and no clock; clocks are whole, and agree with a raw text that is one."""
    p = value["precision"]
    y, m, d, t = (value[c].isNotNull() for c in ("year", "month", "day", "timestamp"))
    parts = F.when(p == "unknown", ~y & ~m & ~d).when(p == "year", y & ~m & ~d).when(p == "month", y & m & ~d).when(p == "day", y & m & d)
    raw = value["raw_value"]
    iso = lambda i: F.nullif(F.regexp_extract(raw, r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?$", i).try_cast("int"), F.lit(0))
    same = ~F.coalesce(raw.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), F.lit(False)) | (value["year"].eqNullSafe(iso(1)) & value["month"].eqNullSafe(iso(2)) & value["day"].eqNullSafe(iso(3)))
    dated = parts & same & ~t & value["source_timezone"].isNull()
    real = ~d | F.concat_ws("-", F.lpad(value["year"].cast("string"), 4, "0"), F.lpad(value["month"].cast("string"), 2, "0"), F.lpad(value["day"].cast("string"), 2, "0")).try_cast("date").isNotNull()
    aware = F.coalesce(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)$"), F.lit(False))
    agrees = ~aware | F.coalesce(F.try_to_timestamp(raw) == value["timestamp"], F.lit(True))
    whole = t & ~y & ~m & ~d & (F.date_trunc("second", value["timestamp"]) == value["timestamp"]) & agrees
    minute = F.date_trunc("minute", value["timestamp"]) == value["timestamp"]
    return sure(F.when(p.isin("unknown", "year", "month", "day"), dated & real).when(p == "minute", whole & minute).when(p == "second", whole))


def range_ordered(low: Column, high: Column) -> Column:
    return F.coalesce(low <= high, F.lit(True))


def unique(values: Column) -> Column:
    return sure(F.size(F.array_distinct(values)) == F.size(values))


#: Which subjects a kind of identifier may have.
SUBJECTS = {"sec_cik": ["entity"], "lei": ["entity"], "figi_share_class": ["security"], "figi_composite": ["security"], "figi_instrument": ["listing"], "isin": ["security"], "cusip": ["security"], "sedol": ["security", "listing"], "other": ["entity", "security", "listing"]}


def identifier_subject(kind: Column, subject: Column, scope: Column) -> Column:
    """Whether a kind of identifier may have the subject; a market scope belongs to composites alone."""
    table = F.create_map(*(x for k, v in SUBJECTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return sure(F.array_contains(F.element_at(table, kind), subject) & (scope.isNotNull() == (kind == "figi_composite")))


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; reading one that breaks the condition raises."""
    bad = F.raise_error(F.lit(message))
    return rows.filter(F.when(sure(condition), True).otherwise(bad.cast("boolean")))
