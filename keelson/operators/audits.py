"""Audits of captures and reports: request journals, counters, candidate envelopes, and rendered reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import canonical_json


def receipt_defects(receipts: DataFrame, spacing_seconds: float = 1.0) -> DataFrame:
    """(request_id, defect): requests of a journal (journal, position, request_id, state, attempted_at, sha256, length) that contradict it.

    Captured ones have hash, length and time; failed ones a time alone; unattempted ones nothing. Attempts
    keep their distance, and none follows a failure.
    """
    w = Window.partitionBy("journal").orderBy("position")
    has = lambda c: F.col(c).isNotNull()
    state = F.col("state")
    tried = F.max("attempted_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    failed = F.coalesce(F.max((state == "failed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    close = F.unix_micros("attempted_at") - F.unix_micros(tried) < int(spacing_seconds * 1_000_000)
    defect = (
        F.when(~state.isin("captured", "failed", "unattempted"), "unknown_state")
        .when((state == "captured") & ~(has("sha256") & has("length") & has("attempted_at")), "captured_without_facts")
        .when((state == "failed") & (~has("attempted_at") | has("sha256")), "failed_with_other_facts")
        .when((state == "unattempted") & (has("attempted_at") | has("sha256") | has("length")), "unattempted_with_facts")
        .when(has("attempted_at") & failed, "attempt_after_failure")
        .when(has("attempted_at") & F.coalesce(close, F.lit(False)), "attempts_too_close")
    )
    return receipts.select("request_id", defect.alias("defect")).filter("defect IS NOT NULL")


def receipt_totals(receipts: DataFrame, stated: DataFrame) -> DataFrame:
    """(journal, what, stated, found): totals that a journal's statement gets wrong; stated has journal, captured, failed, unattempted, bytes."""
    s = F.col("state")
    found = receipts.groupBy("journal").agg(*(F.count_if(s == x).alias(x) for x in ("captured", "failed", "unattempted")), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    names = ("captured", "failed", "unattempted", "bytes")
    both = stated.alias("a").join(found.alias("b"), "journal", "full_outer")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(f"a.{n}").cast("long").alias("stated"), F.col(f"b.{n}").cast("long").alias("found")) for n in names)))
    return both.select("journal", each.alias("x")).select("journal", "x.*").filter("NOT (stated <=> found)")


def missing_objects(receipts: DataFrame, objects: DataFrame) -> DataFrame:
    """Captured requests whose object is not stored, or has another length."""
    o = objects.select(F.col("sha256").alias("its_sha"), F.col("length").alias("its_length"))
    return receipts.filter("state = 'captured'").join(o, (F.col("sha256") == F.col("its_sha")) & (F.col("length") == F.col("its_length")), "left_anti")


def counters(rows: DataFrame, *columns: str, sep: str = "|") -> DataFrame:
    """(key, n): how often each combination of the columns occurs, with the key as one text; a null is 'none'."""
    return rows.groupBy(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns)).alias("key")).agg(F.count("*").alias("n"))


def envelope_statistics(candidates: DataFrame, levels: tuple[str, ...], fields: tuple[str, ...], pointer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of candidate rows: (level, distinct ids, rows with one); (level, id, pointers) of ids that several rows have; (field, missing, empty)."""
    long = candidates.select(pointer, F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("id")) for x in levels))).alias("x")).select(pointer, "x.*")
    known = long.filter("id IS NOT NULL AND id <> ''")
    distinct = known.groupBy("level").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("rows"))
    shared = known.groupBy("level", "id").agg(F.array_sort(F.collect_set(pointer)).alias("pointers")).filter("size(pointers) > 1")
    each = candidates.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("missing"), (F.col(f).cast("string") == "").alias("empty")) for f in fields))).alias("x")).select("x.*")
    gaps = each.groupBy("field").agg(F.count_if("missing").alias("missing"), F.count_if(F.coalesce("empty", F.lit(False))).alias("empty"))
    return distinct, shared, gaps


def duplicate_excess(rows: DataFrame) -> DataFrame:
    """(excess): rows beyond the first of equal ones, told by all their columns."""
    return rows.select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small aggregate as a table, in a fixed order; null is 'unavailable'."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.orderBy(*order).select(*columns).collect():
        lines.append("| " + " | ".join("unavailable" if v is None else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def report(title: str, facts: dict, tables: dict[str, tuple[DataFrame, list[str], list[str]]]) -> tuple[bytes, bytes]:
    """The same report as canonical JSON and as Markdown; the same inputs give the same bytes."""
    body = {"title": title, "facts": facts, "tables": {}}
    parts = [f"# {title}", "", *(f"{k}: {v}" for k, v in sorted(facts.items())), ""]
    for name, (rows, columns, order) in tables.items():
        body["tables"][name] = [{c: None if r[c] is None else str(r[c]) for c in columns} for r in rows.orderBy(*order).collect()]
        parts += [f"## {name}", "", markdown_table(rows, columns, order)]
    return canonical_json(json.loads(json.dumps(body, default=str))), ("\n".join(parts)).encode()


def regenerated(captures: DataFrame, derive: Callable[[DataFrame], DataFrame], stored: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """A report derived anew from immutable captures, and whether it is the stored one."""
    again = derive(captures)
    if stored is None:
        return again, True
    columns = sorted(again.columns)
    a, b = again.select(*columns), stored.select(*columns)
    return again, a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
