import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import TEXTS  # noqa: E402


def write(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", None if i == 9 else f"s{(i or 0) % 3}", len(t or ""), "clash", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, token string, t long, d long, fp long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i == 13)) for i, _ in rows if i] + ([(13, None, None), (99, 1, 1)] if rows else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clicks = [(i, f"2024-01-0{1 + i % 3} 10:{i % 60:02}:0{i % 7}", i % 5, ["view", "click", "purchase", "error", None][i % 5]) for i in range(200)] if rows else []
    spark.createDataFrame(clicks, "click_id long, ts string, client_id long, kind string").selectExpr("click_id", "CAST(ts AS timestamp_ntz) AS ts", "client_id", "kind").write.parquet(f"{folder}/clicks.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), TEXTS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])
