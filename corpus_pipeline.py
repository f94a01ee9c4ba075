"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Stages take null ids, texts and sources, empty and long texts, repeated rows, ties, empty tables and extra
columns as their own docstrings say. A stage's folder goes when the next stage has been written from it;
the last one's, which the result reads, stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import mixing, pieces, simhash, suffixes, toxicity
from keelson.llm.common import documents, remove, shared_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("suffix_array_dedup", suffixes.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL can't express fingerprint search, suffix order, the balanced draw or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
