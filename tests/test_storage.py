"""Bucketed upserts that survive a crash, footers, digest trees, captures by executors and paged bars."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.sources import captures, datasets, files, store


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def pay():
    return F.to_json(F.struct("k", "v"))


def held(spark, path):
    return sorted(tuple(r) for r in datasets.read_dataset(spark, path).collect())


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    first = [(i, f"v{i}") for i in range(500)]
    assert datasets.upsert(spark, path, keyed(spark, first), "k", pay())
    before = datasets.manifest(spark, path)[1]["versions"]
    assert len(before) == datasets.BUCKETS
    assert datasets.upsert(spark, path, keyed(spark, [(7, "v7"), (900, "new"), (901, "new"), (901, "new")]), "k", pay())
    after = datasets.manifest(spark, path)[1]["versions"]
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    assert held(spark, path) == sorted([*first, (900, "new"), (901, "new")])
    assert not datasets.upsert(spark, path, keyed(spark, [(900, "new")]), "k", pay()) and datasets.manifest(spark, path)[0] == 2
    for rows in ([(900, "other")], [(1000, "a"), (1000, "b")]):
        with pytest.raises(files.ConflictError):
            datasets.upsert(spark, path, keyed(spark, rows), "k", pay())
    assert not datasets.upsert(spark, path, keyed(spark, []), "k", pay())
    datasets.vacuum(spark, path)
    assert held(spark, path) == sorted([*first, (900, "new"), (901, "new")])
    kept = {n for n in files.listed(spark, f"{path}/data") if n.endswith(".parquet")}
    assert len({n.rsplit("/", 1)[0] for n in kept}) == datasets.BUCKETS


def test_no_join_broadcasts_what_is_stored(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    datasets.upsert(spark, path, keyed(spark, [(i, f"v{i}") for i in range(100)]), "k", pay())
    rows = keyed(spark, [(1, "v1"), (900, "new")])
    stored = datasets.read_dataset(spark, path, rows.schema)
    for found in (datasets.classify(stored, rows, "k", pay()), datasets.fresh_rows(stored, rows, "k")):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in datasets.fresh_rows(stored, rows, "k").collect()] == [900]


@pytest.mark.parametrize("step", ["data", "log"])
def test_a_stopped_upsert_leaves_the_dataset_readable(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/d"
    datasets.upsert(spark, path, keyed(spark, [(i, "a") for i in range(40)]), "k", pay())
    with monkeypatch.context() as m:
        if step == "data":  # the write fails half way
            bad = keyed(spark, [(100, "a"), (101, "b")]).withColumn("v", F.when(F.col("k") == 101, F.raise_error(F.lit("stopped"))).otherwise(F.col("v")))
            with pytest.raises(PySparkException):
                datasets.upsert(spark, path, bad, "k", F.lit(1))
        else:  # the data is whole, and the manifest isn't written
            def stopped(*_):
                raise OSError("stopped")
            m.setattr(datasets.files, "write_once", stopped)
            with pytest.raises(OSError):
                datasets.upsert(spark, path, keyed(spark, [(100, "a")]), "k", pay())
    assert held(spark, path) == [(i, "a") for i in range(40)]
    assert datasets.upsert(spark, path, keyed(spark, [(100, "a")]), "k", pay())
    assert len(held(spark, path)) == 41
    gone = datasets.vacuum(spark, path)
    assert (step == "log") == bool(gone) or step == "data"
    assert len(held(spark, path)) == 41


def test_the_slower_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    datasets.upsert(spark, path, keyed(spark, [(1, "a")]), "k", pay())
    whole = datasets.files.write_once

    def late(spark, at, content):
        monkeypatch.setattr(datasets.files, "write_once", whole)
        datasets.upsert(spark, path, keyed(spark, [(2, "theirs")]), "k", pay())
        return whole(spark, at, content)

    monkeypatch.setattr(datasets.files, "write_once", late)
    with pytest.raises(files.ConflictError):
        datasets.upsert(spark, path, keyed(spark, [(2, "mine")]), "k", pay())
    assert held(spark, path) == [(1, "a"), (2, "theirs")]


def test_a_foreign_part_file_is_named(spark, tmp_path):
    path, contract = f"file://{tmp_path}/d", {"dataset": "x", "schema_version": "1"}
    datasets.upsert(spark, path, keyed(spark, [(i, "a") for i in range(40)]), "k", pay(), contract)
    datasets.check_footers(spark, path, "k", contract)
    _, body = datasets.manifest(spark, path)
    paths = [f"{path}/data/{v}/bucket={b}" for b, v in body["versions"].items()]
    assert datasets.footers(spark, paths, "k").agg(F.sum("rows"), F.count_distinct("contract")).first() == (40, 1)
    with pytest.raises(files.ConflictError, match="schema_version"):
        datasets.check_footers(spark, path, "k", contract | {"schema_version": "2"})
    bucket, version = next(iter(body["versions"].items()))
    keyed(spark, [(99, "z")]).coalesce(1).write.mode("append").parquet(f"{path}/data/{version}/bucket={bucket}")
    foreign = max(((tmp_path / f"d/data/{version}/bucket={bucket}").glob("part-*.parquet")), key=os.path.getmtime)
    with pytest.raises(files.ConflictError, match=foreign.name):
        datasets.check_footers(spark, path, "k", contract)


def leaves(spark, rows, depth=2):
    return datasets.digest_tree(keyed(spark, rows), ["k"], depth)


def test_digest_trees_find_the_changed_range(spark):
    rows = [(i, f"v{i}") for i in range(300)]
    base = leaves(spark, rows)
    assert base.filter("level = 0").first()["rows"] == 300 and base.filter("level = 1").count() == 16
    assert datasets.tree_differences(base, leaves(spark, rows[::-1])).isEmpty()
    assert datasets.tree_differences(base, datasets.digest_tree(keyed(spark, rows).repartition(7), ["k"], 2)).isEmpty()
    for other, changed in (([(5, "x") if r[0] == 5 else r for r in rows], 1), (rows + [rows[9]], 1), (rows[1:], 1), ([(1000 + r[0], r[1]) if r[0] == 5 else r for r in rows], 2)):
        found = datasets.tree_differences(base, leaves(spark, other)).collect()
        assert {r["level"] for r in found} == {0, 1, 2} and sum(r["level"] == 2 for r in found) <= changed
    swapped = [(1, "v2"), (2, "v1"), *rows[:1], *rows[3:]]  # the same values at other keys
    assert not datasets.tree_differences(base, leaves(spark, swapped)).isEmpty()
    assert leaves(spark, []).isEmpty() and [datasets.depth_for(n) for n in (0, 256, 257, 5000, 10**6)] == [1, 1, 1, 2, 3]


def test_a_frozen_snapshot_names_what_was_changed(spark, tmp_path):
    target = f"file://{tmp_path}/frozen"
    a, b = keyed(spark, [(i, "a") for i in range(600)]), keyed(spark, [])
    body = store.freeze({"a": a, "b": b}, target, keys={"a": ["k"]})
    assert store.verify(spark, target) and [(e["name"], e["rows"]) for e in body["entries"]] == [("a", 600), ("b", 0)]
    changed = a.withColumn("v", F.when(F.col("k") == 77, "z").otherwise(F.col("v")))
    changed.write.mode("overwrite").parquet(f"{target}/a")
    found = store.differences(spark, target).collect()
    assert not store.verify(spark, target) and {r["dataset"] for r in found} == {"a"} and [r["stated_rows"] for r in found if r["level"] == 0] == [600]


def test_a_folder_is_captured_by_executors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(120):
        (tmp_path / f"in/{i}.txt").write_text(f"body {i % 100}")
    root = f"file://{tmp_path}/root"
    for _ in range(2):  # a repeated job changes nothing
        captures.capture_folder(spark, f"file://{tmp_path}/in", root, retrieved_at="2024-01-01T00:00:00Z")
        found = captures.captured(spark, root)
        assert found.count() == 120 and found.select("content_sha256").distinct().count() == 100
    objects = [p for p in (tmp_path / "root/raw/objects").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert len(objects) == 100
    bad = spark.createDataFrame([("c", "n", b"x", '{"api_key": 1}')], "collection string, name string, content binary, parameters string")
    with pytest.raises(PySparkException, match="credential"):
        captures.capture_rows(bad, root)
    assert captures.captured(spark, root).count() == 120
    objects[0].write_text("altered")
    with pytest.raises(PySparkException, match="not what its name says"):
        captures.capture_folder(spark, f"file://{tmp_path}/in", root)


def test_an_aborted_capture_shows_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    schema = "collection string, name string, content binary, parameters string"
    captures.capture_rows(spark.createDataFrame([("c", "one", b"1", None)], schema), root)
    rows = spark.createDataFrame([("c", f"n{i}", str(i).encode(), None) for i in range(50)], schema).repartition(5)
    stopped = rows.withColumn("content", F.when(F.col("name") == "n33", F.raise_error(F.lit("stopped")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(PySparkException, match="stopped"):
        captures.capture_rows(stopped, root)
    assert [r["name"] for r in captures.captured(spark, root).collect()] == ["one"]
    assert list(captures.Collection(root, "c").manifests) == ["one"]


def page(symbol, days, token=None, price=1.5, **more):
    bars = [{"t": f"{d}T05:00:00Z", "o": price, "h": 2, "l": 1, "c": 1.25, "v": 7} | more for d in days]
    return json.dumps({"bars": {symbol: bars}, "next_page_token": token})


def stored_pages(spark, root, segment, pages):
    rows = [(segment.collection, name, body.encode(), json.dumps({"cursor": name})) for name, body in pages.items()]
    captures.capture_rows(spark.createDataFrame(rows, "collection string, name string, content binary, parameters string"), root, retrieved_at="2024-02-01T00:00:00Z")


def test_paged_bars_are_clipped_chained_and_exact(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    day = dt.date
    asked = captures.segments([("l", "OLD", day(2020, 1, 1), day(2024, 1, 4)), ("l", "NEW", day(2024, 1, 4), None), ("l", "GONE", day(2020, 1, 1), day(2021, 1, 1))], day(2024, 1, 1), day(2024, 1, 31))
    assert [(s.symbol, s.first, s.last) for s in asked] == [("OLD", day(2024, 1, 1), day(2024, 1, 3)), ("NEW", day(2024, 1, 4), day(2024, 1, 31))]
    stored_pages(spark, root, asked[0], {"": page("OLD", ["2024-01-02", "2024-01-03"], price=0.1)})
    stored_pages(spark, root, asked[1], {"": page("NEW", ["2024-01-05", "2024-01-04"], "t1"), "t1": page("NEW", ["2024-01-05", "2024-01-08"], "t2"), "t2": page("NEW", [])})
    bars = captures.paged(spark, root, asked)
    rows = captures.listing_bars(bars).orderBy("session_date").collect()
    assert [(str(r["session_date"]), r["symbol"], r["page"]) for r in rows] == [("2024-01-02", "OLD", 0), ("2024-01-03", "OLD", 0), ("2024-01-04", "NEW", 0), ("2024-01-05", "NEW", 0), ("2024-01-08", "NEW", 1)]
    assert rows[0]["open"] == Decimal("0.1") and rows[0]["volume"] == 7
    pages = captures.paged(spark, root, asked, rows="pages").collect()
    assert len(pages) == 4 and len({r["observation_id"] for r in pages}) == 4 and {r["observation_id"] for r in bars.collect()} < {r["observation_id"] for r in pages}
    only = bars.filter("symbol = 'NEW' AND session_date >= DATE '2024-01-05'")
    assert only.rdd.getNumPartitions() == 1 and only.count() == 2
    assert bars.filter("session_date > DATE '2030-01-01'").count() == 0


@pytest.mark.parametrize(("pages", "says"), [
    ({"": page("S", ["2024-01-02"], "a"), "a": page("S", [], "a")}, "comes again"),
    ({"": page("S", ["2024-01-02"], "a")}, "was not captured"),
    ({"": page("S", ["2024-03-01"])}, "outside"),
    ({"": page("S", ["2024-01-02"], "a"), "a": page("S", ["2024-01-02"], price=9)}, "two bars"),
    ({"": page("T", ["2024-01-02"])}, "no page of bars"),
    ({"": page("S", ["2024-01-02"], o=True)}, "no page of bars"),
    ({"": page("S", ["2024-01-02"], t="2024-01-02T06:00:00Z")}, "no page of bars"),
    ({"": page("S", ["2024-01-02"], v=1.5)}, "no page of bars"),
    ({"": '{"bars": {"S": [{"t": "2024-01-02T05:00:00Z", "o": NaN, "h": 1, "l": 1, "c": 1}]}}'}, "no page of bars"),
    ({"": page("S", [], "t0")} | {f"t{i}": page("S", [], f"t{i + 1}") for i in range(100)}, "over 100 pages"),
])
def test_broken_chains_raise(spark, tmp_path, pages, says):
    asked = [captures.Segment("l", "S", dt.date(2024, 1, 1), dt.date(2024, 1, 31))]
    stored_pages(spark, f"file://{tmp_path}/root", asked[0], pages)
    with pytest.raises(PySparkException, match=says):
        captures.paged(spark, f"file://{tmp_path}/root", asked).collect()


def test_a_listings_symbols_must_agree(spark):
    bars = spark.createDataFrame([("l", "A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1, 0, "x"), ("l", "B", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1, 0, "y")], "listing_id string, symbol string, session_date date, open double, high double, low double, close double, volume long, page int, observation_id string")
    assert captures.listing_bars(bars).count() == 1
    with pytest.raises(PySparkException, match="conflicting"):
        captures.listing_bars(bars.withColumn("volume", F.when(F.col("symbol") == "B", 2).otherwise(1))).collect()
