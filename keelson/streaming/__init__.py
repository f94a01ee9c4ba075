"""Structured Streaming: new records as they arrive, each once, into a conflict-checked dataset; first records by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import ship
from ..sources.store import upsert


def arrivals(spark: SparkSession, path: str, schema: str, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """New Parquet files below ``path``; repeats of a key within the watermark come once."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def upsert_stream(rows: DataFrame, target: str, key: str, payload: Column, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch; a batch that is run again changes nothing, and a conflict ends the query."""
    write = lambda batch, _: upsert(batch.sparkSession, target, batch, key, payload)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstSeen(StatefulProcessor):
    """Per key the earliest record (by time, then meaning) and whether any record differs in meaning; emits when that changes.

    ``version`` counts a key's emissions, so the newest is the answer so far, in whatever order records come.
    A record that comes again changes nothing.
    """

    def __init__(self, key: str, at: str, meaning: str) -> None:
        self.key, self.at, self.meaning = key, at, meaning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at timestamp, meaning string, conflict boolean, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        at, meaning, conflict, version = held or (None, None, False, 0)
        for part in rows:
            low = part.sort_values([self.at, self.meaning], kind="stable").iloc[0]
            kinds = set(part[self.meaning]) | ({meaning} if version or at is not None else set())
            conflict = conflict or len(kinds) > 1
            if at is None or (low[self.at], low[self.meaning]) < (at, meaning):
                at, meaning = low[self.at].to_pydatetime(), low[self.meaning]
        now = (at, meaning, conflict)
        if held is None or now != tuple(held)[:3]:
            self.first.update((*now, version + 1))
            yield pd.DataFrame({self.key: [key[0]], self.at: [at], self.meaning: [meaning], "conflict": [conflict], "version": [version + 1]})

    def close(self) -> None:
        pass


def first_seen_stream(rows: DataFrame, key: str, at: str, meaning: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each key's first record, whenever it or its conflict changes, to Parquet files; state lives in a store by key."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(rows.dtypes)
    found = rows.groupBy(key).transformWithStateInPandas(FirstSeen(key, at, meaning), f"`{key}` {kinds[key]}, `{at}` timestamp, `{meaning}` string, conflict boolean, version long", "Append", "None")
    return found.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(emitted: DataFrame, key: str) -> DataFrame:
    """The newest emission of each key."""
    others = [c for c in emitted.columns if c not in (key, "version")]
    return emitted.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("r")).select(key, "r.*")
