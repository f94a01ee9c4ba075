"""First-seen records by state: replays, late records and restarts give the batch's answer."""

import datetime as dt
import random

from keelson.sources import store
from keelson.streaming import first_seen_stream, latest


def test_state_over_restarts_and_replays(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randint(1, 12), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 50)), rng.choice(["a", "a", "b"]) if k % 3 else "a") for k in range(120)]
    source, target, check = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    schema = "k long, at timestamp, v string"
    seen = []
    for part in (rows[:40], rows[40:80], rows[20:60], rows[80:]):  # the third replays what has come
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        seen += part
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        first_seen_stream(stream, "k", "at", "v", target, check).awaitTermination(120)  # a new start on the same state
        got = sorted(tuple(r) for r in latest(spark.read.parquet(target), "k").select("k", "at", "v", "conflict").collect())
        want = store.first_seen(spark.createDataFrame(seen, schema), "k", "at", ["v"]).select("k", "at", "v", "conflict")
        assert got == sorted(tuple(r) for r in want.collect())
    before = spark.read.parquet(target).count()
    stream = spark.readStream.schema(schema).parquet(source)
    first_seen_stream(stream, "k", "at", "v", target, check).awaitTermination(120)  # nothing new
    assert spark.read.parquet(target).count() == before
