"""Packing, the filter audit and funnels against brute force, over nulls, repeats, ties, hot keys and clashing columns."""

import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from llm_texts import TEXTS
from pyspark.sql import functions as F

from keelson.llm import filter_audit, funnels, packed, packing

SF = "/root/testdata/sf0.001"


def test_differencing_places_every_size_and_balances():
    rng = np.random.default_rng(3)
    for n, windows in ((0, 3), (1, 4), (5, 5), (40, 7), (300, 30)):
        sizes = rng.integers(1, 256, n)
        found = packing.difference(sizes, windows)
        assert len(found) == n and (found >= 0).all() and (found < windows).all()
        sums = np.bincount(found, sizes, windows)
        if n >= 40:
            assert sums.max() - sums.min() <= sizes.max() / 4  # nearly equal
    # the textbook case of two ways: the final difference is that of differencing by hand
    sums = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]


def test_window_count_rises_until_all_fit():
    found = packing.fill(np.array([600, 600, 600]), 1024)  # two windows would do by their sum
    assert sorted(found) == [0, 1, 2]
    with pytest.raises(ValueError):
        packing.fill(np.array([1025]), 1024)


def test_packing_against_the_library(spark, edge):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{edge}/documents.parquet")
    got = packing.pack(packing.pieces(docs), group=16).toPandas()
    library = Tokenizer.from_file(packed.vocabulary_path())
    want = {}
    for i, text in TEXTS:
        want.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    assert got["doc_tokens"].sum() >= 0 and got["length"].sum() == sum(len(x) for v in want.values() for x in v)
    for r in got.itertuples():
        doc_id = None if np.isnan(r.doc_id) else int(r.doc_id)
        ids = next(x for x in want[doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, rows in got.sort_values("start").groupby("doc_id", dropna=False):
        copies = len(rows[rows["start"] == 0])
        assert rows.drop_duplicates("start")["length"].sum() * copies == rows["length"].sum() == rows["doc_tokens"].iloc[0] * copies
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["length"].sum() <= 1024 and (rows["offset"] == rows["length"].cumsum() - rows["length"]).all()


def test_packing_leaves_little_padding(spark):
    used = packing.op11_packing(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    windows, ids = used.agg(F.count("*"), F.sum("n")).first()
    assert ids / (windows * 1024) > 0.99


def audited(docs, labels):
    """Every figure by its definition."""
    texts = [(i, t or "", s or "") for i, t, s in docs]
    out = {}
    for i, text, part in texts:
        words = text.encode().split()
        fails = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text),
            i is not None and any(j is not None and j < i and other == text for j, other, _ in texts),
        ]
        good, toxic = (any(d == i and d is not None and row[k] == 1 for d, *row in labels) for k in (0, 1))
        first = {order: next((x for x in order if fails["ABCDE".index(x)]), None) for order in map("".join, permutations("ABCDE"))}
        for order in first:
            for step, x in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 7)
                own = fails["ABCDE".index(x)]
                gone = any(fails["ABCDE".index(y)] for y in order[: step - 1])
                removed = own and not gone
                shapley = sum(v == x for v in first.values())
                for k, v in enumerate((not own and not gone, removed, own and gone, own and sum(fails) == 1, removed and good, removed and toxic, shapley)):
                    row[k] += v
    return sorted((*k, *v) for k, v in out.items())


MARKED = [
    *((i, t, f"s{(i or 0) % 3}") for i, t in TEXTS),
    (20, "A text that stands twice.", None), (21, "A text that stands twice.", "s1"), (None, "A text that stands twice.", "s1"),
    (20, "A text that stands twice.", ""), (22, "x" * 300 + " end one", "s0"), (23, "x" * 300 + " end two", "s0"), (24, "x" * 300 + " end two", "s0"),
    (20, "Another text of that id", "s2"), (19, "Another text of that id", "s2"), (25, None, "s2"), (26, "SHOUT " * 60, "s1"),
]
LABELS = [(20, 1, 0), (20, 0, 1), (21, 1, None), (22, None, 1), (None, 1, 1), (99, 1, 1), (26, 1, 1)]


def frames(spark):
    docs = spark.createDataFrame([(i, t, s, 7, "clash", 1) for i, t, s in MARKED], "doc_id long, text string, source string, length int, part string, mask int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_against_brute_force(spark):
    got = sorted(map(tuple, filter_audit.audit(*frames(spark)).collect()))
    assert got == audited(MARKED, LABELS)


@pytest.mark.parametrize("held", [1, 7])
def test_audit_when_block_hashes_collide(spark, monkeypatch, held):
    whole = filter_audit.keyed
    few = lambda docs: whole(docs).withColumns({k: F.pmod(F.col(k), F.lit(held)) for k in filter_audit.KEYS})
    monkeypatch.setattr(filter_audit, "keyed", few)
    got = sorted(map(tuple, filter_audit.audit(*frames(spark)).collect()))
    assert got == audited(MARKED, LABELS)


def test_refinement_drops_what_stands_alone(spark):
    docs, labels = frames(spark)
    alike = filter_audit.refined(filter_audit.masked(filter_audit.keyed(docs), labels)).select("doc_id").collect()
    assert sorted(r[0] for r in alike) == [1, 3, 3, 4, 5, 19, 20, 20, 20, 21, 23, 24, 25]


def walked(rows, defined, within):
    """Every attempt by its definition."""
    rows = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    out = {}
    for f in defined:
        for client, kind, at in rows:
            if kind != f.steps[0]:
                continue
            n, times = out.setdefault((f.name, client), ([0] * len(f.steps), [[] for _ in f.steps]))
            n[0] += 1
            for s, wanted in enumerate(f.steps[1:], 1):
                later = [t for c, k, t in rows if c == client and k == wanted and t > at]
                if not later or min(later) - at > within or any(c == client and k in f.excluded and at < t <= min(later) for c, k, t in rows):
                    break
                n[s] += 1
                times[s].append(min(later) - at)
                at = min(later)
    deepest = {k: max(i + 1 for i, x in enumerate(n) if x) for k, (n, _) in out.items()}
    same = lambda k: sum(d == deepest[k] and j[0] == k[0] for j, d in deepest.items())
    return sorted((k[0], k[1], *n, deepest[k], *(sorted(x)[(len(x) + 1) // 2 - 1] if x else None for x in t[1:]), same(k)) for k, (n, t) in out.items())


def clicked(spark, rows):
    minute = lambda t: None if t is None else f"2024-02-03 {t // 60:02}:{t % 60:02}:00"
    made = spark.createDataFrame([(c, k, minute(t), 1, "clash", 2) for c, k, t in rows], "client_id long, kind string, ts string, n int, funnel string, step int")
    return made.withColumn("ts", F.expr("CAST(ts AS timestamp_ntz)"))


@pytest.mark.parametrize(("seed", "stretch"), [(1, 1 << 19), (2, 1), (3, 4), (4, 30)])
def test_funnels_against_brute_force(spark, seed, stretch):
    rng = random.Random(seed)
    kinds = ["view", "view", "click", "click", "purchase", "signup", "error", "other", None]
    rows = [(rng.choice([1, 1, 1, 2, 3, -4, None]), rng.choice(kinds), rng.choice([None, *range(0, 240, rng.choice([1, 2, 5]))])) for _ in range(400)]
    got = sorted(map(tuple, funnels.funnels(clicked(spark, rows + rows[:50]), stretch=stretch).collect()), key=repr)
    minutes = [(*x[:7], *(None if t is None else t // 60_000_000 for t in x[7:10]), x[10]) for x in got]
    assert minutes == sorted(walked(rows, funnels.FUNNELS, 15), key=repr)


def test_an_attempt_goes_on_over_many_stretches(spark):
    rows = [(1, "view", 0), (1, "signup", 1), (1, "click", 5), (1, "signup", 6), (1, "view", 20), (1, "purchase", 35), (1, "error", 36)]
    got = {tuple(r)[:6] for r in funnels.funnels(clicked(spark, rows), stretch=1).collect()}
    assert ("A", 1, 2, 1, 1, 1) in got  # 15 minutes are still in time
    late = [*rows[:-2], (1, "error", 20), rows[-2]]
    got = {tuple(r)[:6] for r in funnels.funnels(clicked(spark, late), stretch=1).collect()}
    assert ("A", 1, 2, 1, 0, 0) in got  # an excluded row at the step's own time ends it


def test_other_funnels_and_limits(spark):
    rows = [(c, k, t) for c in (1, 2) for t, k in enumerate(["a", "b", "a", "c", "b", "d", "a"])]
    defined = (funnels.Funnel("long", ("a", "b", "a", "b", "d"), ()), funnels.Funnel("one", ("a",), ("b",)), funnels.Funnel("two", ("b", "d"), ("c", "a")))
    got = funnels.funnels(clicked(spark, rows), defined, within=2 * 60_000_000, stretch=2)
    found = {(r["funnel"], r["client_id"]): [r[f"n{i}"] for i in range(1, 6)] for r in got.collect()}
    assert found == {(f, c): n for c in (1, 2) for f, n in (("long", [3, 2, 2, 1, 1]), ("one", [3, 0, 0, 0, 0]), ("two", [2, 1, 0, 0, 0]))}


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_ordered_funnels"])
def test_query_against_its_sql(spark, name):
    from keelson.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for table in ("documents", "labels", "clicks"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in queries()[name](spark, SF).select(columns).collect())
