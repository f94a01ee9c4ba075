"""Full and incremental regeneration give one report; changed captures are found."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.sources import captures, regeneration

SCHEMA = "collection string, name string, content binary, parameters string"


def words(found):
    w = F.explode(F.split(F.decode("content", "UTF-8"), " "))
    return found.select("digest", w.alias("key")).filter("key <> ''").groupBy("digest", "key").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("total"))


def put(spark, root, texts):
    captures.capture_rows(spark.createDataFrame([("c", n, t.encode(), None) for n, t in texts.items()], SCHEMA), root)


def report(run):
    return sorted((r["key"], r["n"], int(r["total"])) for r in run.report.collect())


def test_incremental_runs_equal_a_full_one(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    put(spark, root, {"a": "x y x", "b": "y z", "empty": ""})
    first = regeneration.regenerate(spark, root, f"{root}/r1", words)
    assert first.derived == 3 and report(first) == [("x", 2, 2), ("y", 2, 2), ("z", 1, 1)]
    put(spark, root, {"c": "zz y", "d": "x y x"})  # d has the bytes of a
    second = regeneration.regenerate(spark, root, f"{root}/r1", words)
    full = regeneration.regenerate(spark, root, f"{root}/r2", words)
    assert (second.derived, full.derived) == (1, 4) and second.changed.isEmpty()
    assert report(second) == report(full) == [("x", 4, 4), ("y", 4, 4), ("z", 1, 1), ("zz", 1, 2)]
    again = regeneration.regenerate(spark, root, f"{root}/r1", words)
    assert again.derived == 0 and report(again) == report(full)
    put(spark, root, {"b": "y other"})  # the name now has two captures, of which one is new
    third = regeneration.regenerate(spark, root, f"{root}/r1", words)
    assert third.derived == 1 and [r["name"] for r in third.changed.collect()] == ["c/b"]


def test_an_object_changed_in_place_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    put(spark, root, {"a": "x", "b": "y"})
    assert regeneration.damaged(spark, root).isEmpty()
    held = sorted(p for p in (tmp_path / "root/raw/objects").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    held[0].write_text("altered")
    assert [r["digest"] for r in regeneration.damaged(spark, root).collect()] == [held[0].name]
    with pytest.raises(PySparkException, match="not what its name says"):
        regeneration.regenerate(spark, root, f"{root}/r", words)


def test_captures_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    root, tasks = f"file://{tmp_path}/root", []
    put(spark, root, {str(i): f"x {i}" for i in range(40)})

    def counted(found):
        tasks.append(len({r[0] for r in found.select(F.spark_partition_id()).collect()}))
        return words(found)

    monkeypatch.setattr(regeneration, "DERIVED", 4, raising=False)
    run = regeneration.regenerate(spark, root, f"{root}/r", counted)
    assert run.derived == 40 and tasks == [10] and ("x", 40, 40) in report(run)
