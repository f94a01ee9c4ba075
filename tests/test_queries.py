"""Every query against its SQL in DuckDB at sf0.001."""

import datetime
import os

import duckdb
import pytest

from keelson.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "clicks", "sales", "clients", "client_changes"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    return str(x) if isinstance(x, datetime.date) else int(x) if isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    found = QUERIES[name](spark, SF)
    con = views().execute(SQL[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in con.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in found.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and len(QUERIES) == 76


def test_status_counts_are_complete(spark):
    rows = QUERIES["q01_outcome_status"](spark, SF).collect()
    by = {}
    for r in rows:
        by[r["horizon"]] = by.get(r["horizon"], 0) + r["n"]
    assert set(by.values()) == {1500} and len(rows) == 21
