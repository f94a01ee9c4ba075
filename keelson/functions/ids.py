"""Identifier normalisation, deterministic ids and hashes."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of each kind of identifier.
PATTERNS = {"lei": "^[A-Z0-9]{20}$", "figi": "^[A-Z0-9]{12}$", "isin": "^[A-Z]{2}[A-Z0-9]{9}[0-9]$", "cusip": "^[A-Z0-9*@#]{9}$", "sedol": "^[A-Z0-9]{7}$"}


def registrant_number(raw: Column) -> Column:
    """Ten digits, zero-filled; null unless one to ten ASCII digits that are not all zero."""
    value = F.trim(raw)
    padded = F.lpad(value, 10, "0")
    return F.when(value.rlike("^[0-9]{1,10}$") & (padded != "0" * 10), padded)


def identifier(kind: Column, raw: Column) -> Column:
    """The identifier trimmed and in upper case, null where its kind's pattern doesn't match; numbers of registrants by their own rule."""
    value = F.upper(F.trim(raw))
    out = F.when(kind == "cik", registrant_number(raw))
    for name, pattern in PATTERNS.items():
        out = out.when((kind == name) & value.rlike(pattern), value)
    return out


def prefixed(*parts: Column) -> Column:
    """Parts joined unambiguously: each with its number of characters before it."""
    return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5), as the text that other implementations give."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def content_hash(*columns: str) -> Column:
    """sha256 of the columns as JSON in order of name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
