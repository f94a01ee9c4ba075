"""JSON bodies taken apart, against a walk in Python."""

import json

from keelson.operators import bodies

BODIES = [
    (1, '{"a": 1, "b": {"c/d": null, "e~": [1, [2, {"f": ""}], []]}, "g": "x", "h": true, "i": {}}'),
    (2, "[]"), (3, '"text"'), (4, "null"), (5, "1.50"), (6, ""), (7, None), (8, '{"a": '), (9, '{"a": 1, "a": 2}'),
    (10, '{"x": [{"k": 1, "m": {"n": 1, "n": 2, "n": 3}}], "y": 1, "y": 1}'), (11, '{"a": NaN}'), (12, '{"a": 1}'), (12, '{"a": 2}'),
]


def walked(key, value, pointer="", place=""):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    text = None if kind in ("object", "array", "null") else str(value).lower() if kind == "boolean" else str(value)
    yield key, pointer, place, kind, text, value in ({}, [], "") and not isinstance(value, (bool, int, float))
    inner = value.items() if kind == "object" else enumerate(value) if kind == "array" else ()
    for k, v in inner:
        name = str(k).replace("~", "~0").replace("/", "~1")
        yield from walked(key, v, f"{pointer}/{name}", f"{place}/{name if kind == 'object' else '*'}")


def frame(spark, rows=BODIES):
    return spark.createDataFrame(rows, "id int, body string")


def test_walk_gives_every_value_with_its_pointer(spark):
    sound = [(i, b) for i, b in BODIES if i in (1, 2, 3, 4, 5, 12)]
    want = [w for i, b in sound for w in walked(i, json.loads(b))]
    got = [tuple(r) for r in bodies.walk(frame(spark), "id", "body").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bodies.walk(frame(spark, []), "id", "body").count() == 0


def test_repeated_keys_are_found_at_any_depth(spark):
    got = sorted(tuple(r) for r in bodies.repeated_keys(frame(spark), "id", "body").collect())
    assert got == [(9, "", "a", 2), (10, "", "y", 2), (10, "/x/0/m", "n", 3)]
    assert bodies.repeated_keys(frame(spark, []), "id", "body").count() == 0


def test_statistics_of_places(spark):
    w = bodies.walk(frame(spark, [(1, '{"a": 1, "b": [1, 1, 2]}'), (2, '{"a": "", "b": null}'), (3, '{"b": []}')]), "id", "body")
    got = {(r["place"], r["type"]): tuple(r)[2:] for r in bodies.place_statistics(w, "id").collect()}
    assert got[("/b/*", "number")] == (3, 1, 0, 2) and got[("/a", "string")] == (1, 1, 1, 1) and got[("", "object")] == (3, 3, 0, 0)
    gaps = {r["place"]: tuple(r)[1:] for r in bodies.lacking(w, "id", ["/a", "/b", "/c"]).collect()}
    assert gaps == {"/a": (1, 0, 1), "/b": (0, 1, 1), "/c": (3, 0, 0)}


def rows_of_tasks(spark, run):
    """What run() gives, and the most shuffled rows that one of its tasks read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()) for s in (listed.apply(i) for listed in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(listed.size()))}
    known = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tasks = [found.apply(i).taskMetrics() for found in (store.taskList(*s, 10_000) for s in stages() - known) for i in range(found.size())]
    return out, max(t.get().shuffleReadMetrics().recordsRead() for t in tasks if t.isDefined())


def test_tasks_of_statistics_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(bodies, "BYTES", 1 << 17)  # some 1,200 values
    most = []
    for n in (5_000, 20_000):
        # every body is there twice, one key in a hundred is null, "same" is everywhere
        rows = spark.range(2 * n).selectExpr("nullif(id % {0}, id % {0} DIV 100 * 100) AS id".format(n), "concat('{\"a\": \"same\", \"b\": [', id, ', 1]}') AS body")
        w, walked_rows = rows_of_tasks(spark, lambda rows=rows: bodies.walk(rows, "id", "body"))
        got, read = rows_of_tasks(spark, lambda w=w: {(r["place"], r["type"]): tuple(r)[2:] for r in bodies.place_statistics(w, "id").collect()})
        keys = n - n // 100
        assert got == {("", "object"): (2 * n, keys, 0, 0), ("/a", "string"): (2 * n, keys, 0, 1), ("/b", "array"): (2 * n, keys, 0, 0), ("/b/*", "number"): (4 * n, keys, 0, 2 * n)}
        most.append(max(read, walked_rows))
    assert most[1] < 2_400 and most[1] < 2 * most[0]


def test_empty_values(spark):
    texts = ["[]", "[null]", "[null, null]", "[[]]", "{}", '{"a": null}', '""', "null", "0", "false", '" "', "[ ]", "{ }"]
    got = bodies.walk(frame(spark, list(enumerate(texts))), "id", "body").filter("pointer = ''").orderBy("id").collect()
    assert [texts[r["id"]] for r in got if r["empty"]] == ["[]", "{}", '""', "[ ]", "{ }"]
