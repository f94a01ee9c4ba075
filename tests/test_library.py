"""Golden values and edge cases of the library."""

import datetime as dt
import hashlib
import json
import uuid
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson import control, records, tables
from keelson.functions import calendars, checks, ids, parse, temporal
from keelson.operators import assembly, audits, features, graph, identity, inference, intervals, lineage, reports, sessions
from keelson.sources import adapters, files, readers, store
from keelson.streaming import arrivals, upsert_stream

VALUE = "struct<precision:string,year:int,month:int,day:int,timestamp:timestamp>"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_new_york_sessions(spark):
    cal = calendars.new_york_sessions(spark, "2024-01-01", "2024-12-31").cache()
    day = {r["session_date"]: r for r in cal.collect()}
    assert len(day) == 252
    assert day[dt.date(2024, 7, 3)]["close_utc"] == dt.datetime(2024, 7, 3, 17) and day[dt.date(2024, 11, 29)]["close_utc"] == dt.datetime(2024, 11, 29, 18)
    assert day[dt.date(2024, 3, 8)]["open_utc"] == dt.datetime(2024, 3, 8, 14, 30) and day[dt.date(2024, 3, 11)]["open_utc"] == dt.datetime(2024, 3, 11, 13, 30)
    assert dt.date(2024, 3, 29) not in day and dt.date(2024, 6, 19) not in day
    cases = [("2024-05-06 12:00:00", "2024-05-06"), ("2024-05-06 13:29:59", "2024-05-06"), ("2024-05-06 13:30:00", "2024-05-07"), ("2024-05-04 16:00:00", "2024-05-06"), ("2024-07-04 12:00:00", "2024-07-05"), ("2024-11-29 18:01:00", "2024-12-02")]
    events = spark.createDataFrame(cases, "t string, want string").withColumn("t", F.to_timestamp("t"))
    got = sessions.next_session_by_instant(events, F.col("t"), cal, F.col("open_utc")).collect()
    assert all(str(r["entry_date"]) == r["want"] for r in got)
    start = spark.createDataFrame([(dt.date(2024, 7, 3), 5), (dt.date(2024, 9, 11), 60), (dt.date(2024, 1, 3), 90)], "session_date date, horizon int")
    ends = sessions.nth_session(start.join(cal.select("session_date", "ord"), "session_date"), cal, ordinal="ord").collect()
    assert {str(r["exit_date"]) for r in ends} == {"2024-07-11", "2024-12-05", "2024-05-13"}


def test_eligibility(spark):
    rows = [
        ("2020-05-31 23:59:59", ("month", 2020, 5, None, None), None, "known_after_snapshot"),
        ("2020-06-01 00:00:00", ("month", 2020, 5, None, None), None, "eligible"),
        ("2020-06-01 00:00:00", None, None, "missing_known_from"),
        ("2020-06-01 00:00:00", ("unknown", None, None, None, None), None, "unsupported_known_precision"),
        ("2021-01-01 00:00:00", ("day", 2020, 1, 1, None), ("year", 2021, None, None, None), "known_interval_ended"),
        ("2020-12-31 23:59:59", ("day", 2020, 1, 1, None), ("year", 2021, None, None, None), "eligible"),
    ]
    df = spark.createDataFrame(rows, f"s string, a {VALUE}, b {VALUE}, want string")
    got = df.select(temporal.eligibility(F.to_timestamp("s"), F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_partial_dates_and_local_clocks(spark):
    raw = ["1856-00-00", "2020-02-30", "2020-02-29", "2020-00-05", "2020-13", "2020-07", "999", "3000", "x", None]
    got = [r["p"] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(temporal.partial_date(F.col("r"))["precision"].alias("p")).collect()]
    assert got == ["year", None, "day", None, None, "month", None, "year", None, None]
    clocks = ["20240310023000", "20241103013000", "20240910213000", "2024091021300", None]
    utc = [r["u"] for r in spark.createDataFrame([(c,) for c in clocks], "c string").select(temporal.local_to_utc(F.col("c")).alias("u")).collect()]
    assert utc == [None, None, dt.datetime(2024, 9, 11, 1, 30), None, None]


def test_identifiers(spark):
    assert one(spark, ids.registrant_number(F.col("x")), x=" 320193 ") == "0000320193"
    assert one(spark, ids.registrant_number(F.col("x")), x="0") is None and one(spark, ids.registrant_number(F.col("x")), x="12345678901") is None
    assert one(spark, ids.identifier(F.lit("isin"), F.col("x")), x="us0378331005") == "US0378331005"
    assert one(spark, ids.identifier(F.lit("other"), F.col("x")), x="anything") is None
    for name in ("", "é日本", "a:b"):
        assert one(spark, ids.uuid5(str(uuid.NAMESPACE_URL), F.col("x")), x=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, ids.prefixed(F.lit("é"), F.lit("ab")), x=1) == "1:é2:ab"


def test_strict_parsers(spark):
    cases = {"$1,234.50": 1234.5, "1234": 1234, "12,34": None, "1_000": None, "1e3": None, "": None, "$-5": None}
    for raw, want in cases.items():
        got = one(spark, parse.money(F.col("x")), x=raw)
        assert (got is None) == (want is None) and (got is None or float(got) == want), raw
    assert one(spark, parse.disclosed_range(F.col("x")), x="$1,001 - $15,000")["upper"] == 15000
    assert one(spark, parse.disclosed_range(F.col("x")), x="$15,000 - $1,001") is None
    assert one(spark, parse.strict_json(F.col("x")).isNull(), x='{"a":1,"a":2}') and one(spark, parse.strict_json(F.col("x")).isNull(), x='{"a":NaN}')
    assert one(spark, parse.has_secret_key(F.col("x")), x='{"Api-Key":"x"}') and not one(spark, parse.has_secret_key(F.col("x")), x='{"key":"x"}')


def test_bootstrap_golden_values(spark):
    groups = spark.createDataFrame([(0, 1, 0.25, 1, 0.0), (1, 1, 0.25, 1, 0.0)], "idx int, p_n int, p_sum double, s_n int, s_sum double")
    drawn = inference.draws(spark, "any", 3, 50, 2)
    row = inference.bootstrap(inference.resampled(groups, "any", 3, 50)).first()  # sums that are no whole numbers: by joined draws
    assert (row["resamples"], row["missing"], row["lower"], row["upper"]) == (50, 0, 0.25, 0.25)
    assert len(inference.index_digest(drawn)) == 64
    assert inference.index_digest(drawn) == inference.index_digest(inference.draws(spark, "any", 3, 50, 2, partitions=3))
    mix = spark.createDataFrame([(0, 2, 0.2, 1, 0.1), (1, 1, 0.8, 2, 0.4)], "idx int, p_n int, p_sum double, s_n int, s_sum double")
    assert abs(inference.contrast(mix).first()[0] - 1 / 6) < 1e-12


def test_resampled_sums_are_those_of_joined_draws(spark, monkeypatch):
    groups = spark.createDataFrame([(i, i % 3, i * 7 - 50, i % 2, 11 - i) for i in range(37)], "idx int, p_n long, p_sum long, s_n long, s_sum long")
    found = sorted(map(tuple, inference.resampled(groups, "any", 5, 60).collect()))
    monkeypatch.setattr(inference, "HELD", 10)
    joined = sorted(map(tuple, inference.resampled(groups, "any", 5, 60).collect()))
    assert found == joined and len(found) == 60
    with pytest.raises(ValueError, match="gap"):
        monkeypatch.setattr(inference, "HELD", 100)
        inference.resampled(groups.filter("idx <> 4"), "any", 5, 60)


def test_many_clusters_are_drawn_from_blocks_without_a_join(spark, monkeypatch):
    groups = spark.createDataFrame([(i, i % 3, i * 7 - 50, i % 2, 11 - i) for i in range(37)], "idx int, p_n long, p_sum long, s_n long, s_sum long")
    want = sorted(map(tuple, inference.draws(spark, "any", 5, 60, 37).join(groups, "idx").groupBy("resample").agg(*(F.sum(c) for c in ("p_n", "p_sum", "s_n", "s_sum"))).collect()))

    def joined(*_):
        raise AssertionError("draws are made as rows")

    monkeypatch.setattr(inference, "draws", joined)
    for held, kept, stretch in ((10, 2, 7), (37, 1, 100), (1, 40, 37)):
        for name, value in (("HELD", held), ("KEPT", kept), ("STRETCH", stretch)):
            monkeypatch.setattr(inference, name, value)
        assert sorted(map(tuple, inference.resampled(groups, "any", 5, 60).collect())) == want


def test_draws_are_made_in_the_jvm(spark, monkeypatch):
    groups = [(i, i % 3, i * 7 - 50, i % 2, (11 - i) * 2**40) for i in range(37)]
    plans, stored = [], inference.stored
    monkeypatch.setattr(inference, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or stored(df))
    for domain in ("any", "a domain that is longer than one block of the digest, of sixty-four bytes"):
        start, want = domain.encode() + (5).to_bytes(8, "big"), []
        for r in range(20):
            idx = [int.from_bytes(hashlib.sha256(start + k.to_bytes(8, "big")).digest()[:8], "big") % 37 for k in range(r * 37, r * 37 + 37)]
            want.append((r, *(sum(groups[i][c] for i in idx) for c in (1, 2, 3, 4))))
        df = spark.createDataFrame(groups, "idx int, p_n long, p_sum long, s_n long, s_sum long")
        assert sorted(map(tuple, inference.resampled(df, domain, 5, 20).collect())) == want
    assert plans and not any("MapInArrow" in p or "Python" in p for p in plans)


def test_verdict_boundaries():
    plan = inference.Plan()
    arms = {a: {"complete": 1000, "issuers": 200, "actionable": 1111} for a in inference.ARMS}
    boot = {"resamples": 5000, "missing": 50, "lower": Fraction(1, 10**9)}
    assert inference.verdict(arms, boot, Fraction(1, 10**9), plan) == ("positive", [])
    assert inference.verdict(arms, boot | {"lower": Fraction(0)}, Fraction(1), plan) == ("negative", ["contrast_lower_not_strictly_positive"])
    assert inference.verdict(arms, boot, Fraction(0), plan) == ("negative", ["purchase_net25_not_strictly_positive"])
    assert inference.verdict(arms, boot | {"missing": 51}, Fraction(1), plan) == ("insufficient", ["missing_arm_resamples_above_maximum"])
    for change, reason in (({"complete": 999, "actionable": 1000}, "complete_events_below_minimum"), ({"issuers": 199}, "complete_issuers_below_minimum"), ({"actionable": 1112}, "actionable_coverage_below_minimum_or_undefined"), ({"actionable": 0}, "actionable_coverage_below_minimum_or_undefined")):
        got = inference.verdict(arms | {"equity_sale": arms["equity_sale"] | change}, boot, Fraction(1), plan)
        assert got == ("insufficient", [f"equity_sale:{reason}"])
    both = inference.verdict({}, boot | {"lower": None}, None, plan)
    assert both[0] == "insufficient" and len(both[1]) == 7 and both[1][-1] == "undefined_primary_statistics"
    with pytest.raises(ValueError):
        inference.Plan(minimum_complete_per_arm=10)
    with pytest.raises(ValueError):
        inference.Plan(mechanics=inference.FIXED | {"resamples": 40})
    assert inference.Plan(purpose="invented_engineering", minimum_complete_per_arm=2, minimum_issuers_per_arm=1)


def test_exact_statistics(spark):
    assert inference.decimal50(Fraction(1, 3)) == Decimal("0." + "3" * 50) and inference.decimal50(None) is None
    values = [Fraction(i) for i in range(1, 41)]
    assert inference.nearest_rank(values, Fraction(1, 40)) == 1 and inference.nearest_rank(values, Fraction(39, 40)) == 39 and inference.nearest_rank([], Fraction(1, 2)) is None
    states = inference.common_shock(Fraction(1, 100), Fraction(1, 100), Fraction(4, 100), 200)
    assert [states[s][k] for s in ("down", "up") for k in ("contrast", "lower", "upper")] == [Fraction(-4, 100)] * 3 + [Fraction(4, 100)] * 3
    assert inference.missingness_shift(Fraction(1, 10), Fraction(1, 20), Fraction(1, 10), Fraction(1, 5)) == (Fraction(7, 100), Fraction(4, 100))
    rows = [("equity_purchase", "i1", "complete", 100), ("equity_purchase", "i1", "complete", 201), ("equity_purchase", "i2", "missing_price", None), ("equity_sale", "i2", "complete", 5), ("equity_sale", "i3", "complete", 6), ("equity_sale", "i4", "excluded", None)]
    df = spark.createDataFrame([(60, k, "excluded" if s == "excluded" else "selected", True, s, i, v) for k, i, s, v in rows], "horizon int, event_type string, selection string, timing_eligible boolean, status string, issuer_id string, v long")
    plan = inference.Plan(purpose="invented_engineering", minimum_complete_per_arm=1, minimum_issuers_per_arm=1)
    got = inference.analyze_horizon(df, "v", 10_000, 60, plan, "test")
    p = got["arms"]["equity_purchase"]
    assert (p["selected"], p["actionable"], p["complete"], p["issuers"], p["issuer_counts"]) == (3, 3, 2, 1, {"i1": 2})
    assert p["gross_mean"] == inference.decimal50(Fraction(301, 20_000)) and p["largest_fraction"] == 1 and p["coverage"] == inference.decimal50(Fraction(2, 3))
    groups = [(2, 301, 0, 0), (0, 0, 1, 5), (0, 0, 1, 6)]
    found, counter, missing = [], 0, 0
    for _ in range(5000):
        picked = []
        while len(picked) < 3:
            word = int.from_bytes(hashlib.sha256(b"test" + (1729).to_bytes(8, "big") + counter.to_bytes(8, "big")).digest()[:8], "big")
            counter += 1
            if word < 2**64 // 3 * 3:
                picked.append(groups[word % 3])
        value = inference.exact_contrast(*(sum(g[i] for g in picked) for i in range(4)))
        found, missing = (found + [value], missing) if value is not None else (found, missing + 1)
    assert got["bootstrap"]["missing"] == missing and got["bootstrap"]["lower"] == inference.nearest_rank(found, Fraction(1, 40)) / 10_000 and got["bootstrap"]["upper"] == inference.nearest_rank(found, Fraction(39, 40)) / 10_000
    assert got["verdict"] == "insufficient" and "missing_arm_resamples_above_maximum" in got["reasons"]
    assert inference.analyze_horizon(df, "v", 10_000, 20, plan, "test")["verdict"] == "not_evaluated"
    bad = df.withColumn("issuer_id", F.lit(None).cast("string"))
    with pytest.raises(PySparkException, match="issuer"):
        inference.arm_summaries(bad, "v").collect()


def test_intervals(spark):
    d = dt.date
    rows = spark.createDataFrame([(1, "a", d(2024, 1, 1), d(2024, 1, 5)), (1, "a", d(2024, 1, 1), d(2024, 1, 5)), (1, "b", d(2024, 1, 5), d(2024, 1, 9))], "p int, owner string, s date, e date")
    assert tuple(intervals.sweep(rows, "s", "e", "owner", "p").first())[1:] == (3, 2, 1)
    assert intervals.sweep(rows.limit(0), "s", "e", "owner", "p").count() == 0
    left = spark.createDataFrame([(d(2024, 1, 1), d(2024, 12, 31))], "a date, b date")
    right = spark.createDataFrame([(d(2023, 1, 1), d(2025, 1, 1)), (d(2025, 1, 1), d(2025, 2, 1)), (d(2024, 12, 31), d(2025, 2, 1))], "c date, d date")
    assert intervals.interval_overlaps(left, right, ("a", "b"), ("c", "d")).count() == 2


def test_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "node int, parent int")
    walk = lineage.ancestors(spark, edges)
    assert walk.count() == 6
    with pytest.raises(ValueError, match="cycle"):
        lineage.ancestors(spark, spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int"), depth=8).count()
    with pytest.raises(ValueError, match="deeper"):
        lineage.ancestors(spark, spark.range(1, 20).selectExpr("id AS node", "id + 1 AS parent"), depth=8).count()
    assert identity.unanimous(spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, None)], "k int, v string"), "k", "v").orderBy("k").collect()[1]["v"] is None


def test_upsert_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    pay = F.to_json(F.struct("k", "v"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert store.upsert(spark, path, first, "k", pay) and not store.upsert(spark, path, first, "k", pay)
    assert store.upsert(spark, path, spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), "k", pay)
    with pytest.raises(store.ConflictError):
        store.upsert(spark, path, spark.createDataFrame([(1, "z")], "k int, v string"), "k", pay)
    assert sorted(r["v"] for r in store.read_dataset(spark, path).collect()) == ["a", "b", "c"]
    frozen = f"{tmp_path}/frozen"
    body = store.freeze({"records": store.read_dataset(spark, path)}, frozen)
    assert store.verify(spark, frozen) and body["entries"][0]["rows"] == 3
    spark.createDataFrame([(9, "q", dt.datetime(2024, 1, 1)), (9, "q", dt.datetime(2024, 1, 1))], "k int, v string, at timestamp").write.parquet(f"{tmp_path}/in")
    rows = arrivals(spark, f"{tmp_path}/in", "k int, v string, at timestamp", "k", "at")
    upsert_stream(rows, f"file://{tmp_path}/stream", "k", pay, f"{tmp_path}/cp").awaitTermination(60)
    assert store.read_dataset(spark, f"file://{tmp_path}/stream").count() == 1


XML = """<SEC-HEADER>
ACCESSION NUMBER: 0001-24-1
CONFORMED SUBMISSION TYPE: 4
<ACCEPTANCE-DATETIME>20240910213000
<ownershipDocument><documentType>4</documentType><issuer><issuerCik>0000000001</issuerCik></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik></reportingOwnerId></reportingOwner>
<nonDerivativeTable>
<nonDerivativeTransaction><transactionDate><value>2024-09-09</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>12.3456</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-09-09</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>M</transactionCode></transactionCoding></nonDerivativeTransaction>
<nonDerivativeHolding><securityTitle><value>x</value></securityTitle></nonDerivativeHolding>
</nonDerivativeTable></ownershipDocument>"""


def test_readers(spark, tmp_path):
    rows = readers.ownership(spark.createDataFrame([("p", XML), ("q", "<!DOCTYPE x>" + XML), ("r", "nothing")], "path string, text string")).collect()
    good = [r for r in rows if r["path"] == "p"]
    assert [r["exclusion"] for r in good] == [None, "unsupported_code", "non_transaction_holding"]
    assert float(good[0]["price"]) == 12.3456 and good[0]["accepted_utc"] == dt.datetime(2024, 9, 11, 1, 30)
    assert {r["defect"] for r in rows if r["path"] != "p"} == {"dtd_or_entity", "not_one_document"}
    body = spark.createDataFrame([("p", '[{"Ticker":"A","Gain":"9"},{"Ticker":"A","Gain":"9"}]')], "path string, body string")
    vendor = readers.vendor_rows(body, ("Ticker",)).collect()
    assert len(vendor) == 2 and vendor[0]["facts"] == {"Ticker": "A"} and json.loads(vendor[0]["quarantined"]) == {"Gain": "9"}
    index = spark.createDataFrame([("p", "CIK|Company Name|Form Type|Date Filed|File Name"), ("p", "1|A|4|2024-09-10|edgar/data/1/0000000001-24-000001.txt"), ("p", "1|A|4|2024-09-10|edgar/data/1/0000000001-24-000001.txt"), ("p", "1|A|4|2024-09-11|edgar/data/1/0000000001-24-000002.txt"), ("p", "2|A|4|2024-09-10|edgar/data/1/0000000001-24-000003.txt")], "path string, value string")
    found = readers.daily_index(index, "2024-09-10")
    assert sorted(str(r["reason"]) for r in found.collect()) == ["None", "None", "other_day", "path_disagrees"]
    group = readers.reference_groups(found.filter("reason IS NULL")).first()
    assert (group["repeats"], group["conflict"]) == (1, False) and group["locator"].endswith("000001.txt")
    graph = {"data": [{"type": "relationships", "id": "7", "attributes": {"entity1_id": 1, "entity2_id": 2, "category_id": 1, "start_date": "1990-00-00"}}], "included": [{"type": "entities", "id": "1", "attributes": {"name": "a"}}]}
    edge = readers.relationships(spark.createDataFrame([("p", json.dumps(graph))], "path string, body string"), {1: "position"}).first()
    assert edge["reason"] == "unresolved_endpoint" and edge["start"]["precision"] == "year"
    page = json.dumps({"bars": {"A": [{"t": "2024-07-03T04:00:00Z", "o": 1.5, "h": 2, "l": 1, "c": 2, "v": 3}, {"t": "2024-07-03T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}]}, "next_page_token": None})
    bars = readers.bar_pages(spark.createDataFrame([("p", page)], "path string, body string")).collect()
    assert sorted(str(b["session_date"]) for b in bars) == ["2024-07-03", "None"]
    mapping = '[{"data":[{"figi":"F1","shareClassFIGI":"S1","compositeFIGI":"C1"}]}]'
    claims = spark.createDataFrame([("p", mapping)], "path string, body string")
    assert readers.instrument_claims(claims).count() == 2 and readers.instrument_claims(claims, "US").count() == 3
    gleif = '{"data":[{"type":"x","id":"L","attributes":{"entity":{"legalName":{"name":"N"}}}}]}'
    entity = spark.createDataFrame([("p", gleif)], "path string, body string")
    assert readers.legal_entities(entity, "L").first()["exact"] and not readers.legal_entities(entity).first()["exact"]
    with pytest.raises(PySparkException, match="another entity"):
        readers.legal_entities(entity, "M").collect()
    jobs = spark.createDataFrame([("a", mapping), ("b", mapping[:-1] + "," + mapping[1:]), ("c", '[{"error":"x"}]'), ("d", '[{"warning":"none"}]')], "path string, body string")
    assert {r["path"]: r["defect"] for r in readers.instrument_defects(jobs).collect()} == {"b": "not_one_job", "c": "job_error"}
    odd = spark.createDataFrame([("a", '[{"A":1,"A":2}]'), ("b", '{"A":1}'), ("c", '[{"A":"1"},{"A":"2"},{"A":"3"}]'), ("d", "[]")], "path string, body string")
    assert {r["path"]: r["body_defect"] for r in readers.vendor_rows(odd, ("A",), 2).collect()} == {"a": "not_strict_json", "b": "not_an_array_of_objects", "c": "too_many_rows"}
    lines = index.union(spark.createDataFrame([("p", "1|A|4"), ("q", "Date of data: 2024-09-11"), ("q", "CIK|Company Name|Form Type|Date Filed|File Name"), ("r", "nothing")], "path string, value string"))
    assert "not_five_fields" in [r["reason"] for r in readers.daily_index(lines, "2024-09-10").collect()]
    assert {r["path"]: r["defect"] for r in readers.index_defects(lines, "2024-09-10").collect()} == {"q": "header_names_another_day", "r": "not_one_line_of_columns"}
    gate = spark.createDataFrame([("a", json.dumps({"meta": {"license": "L", "apiVersion": "2.0", "copyright": "c"}} | graph)), ("b", json.dumps({"meta": {"license": "M"}})), ("c", "{")], "path string, body string")
    assert {r["path"]: r["defect"] for r in readers.graph_defects(gate, "L").collect()} == {"b": "other_license", "c": "not_strict_json"}
    twice = XML.replace("</transactionAmounts></nonDerivativeTransaction>", "</transactionAmounts><transactionAmounts/></nonDerivativeTransaction>")
    wrong = [("a", twice, "repeated_element"), ("b", XML.replace("</reportingOwner>", "<reportingOwnerRelationship><isOther>maybe</isOther></reportingOwnerRelationship></reportingOwner>"), "invalid_owner_flag"), ("c", XML.replace("</transactionPricePerShare>", "</transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode>"), "code_contradicts_side"), ("d", XML + " " * 5_000_000, "too_long")]
    found = {r["path"]: r["defect"] for r in readers.ownership(spark.createDataFrame([w[:2] for w in wrong], "path string, text string")).collect()}
    assert found == {w[0]: w[2] for w in wrong}
    told = XML.replace("</reportingOwner>", "<reportingOwnerRelationship><isDirector>1</isDirector><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner>").replace("</ownershipDocument>", '<derivativeTable><derivativeHolding><securityTitle><value>o</value></securityTitle></derivativeHolding></derivativeTable><footnotes><footnote id="F1">note</footnote></footnotes></ownershipDocument>')
    rows = readers.ownership(spark.createDataFrame([("p", told)], "path string, text string")).collect()
    assert rows[0]["owner_roles"][0]["director"] is True and rows[0]["owner_roles"][0]["officer_title"] == "CEO" and rows[0]["footnotes"] == {"F1": "note"} and rows[-1]["exclusion"] == "derivative_table"
    spark.createDataFrame([("1", '{"id":"1","v":2}')], "record_id string, payload_json string").write.parquet(f"{tmp_path}/env")
    assert readers.envelopes(spark, f"{tmp_path}/env", "id string, v int", "id").first()["v"] == 2


def test_checks(spark):
    v = dict(o=1.0, h=2.0, l=0.5, c=1.5)
    assert one(spark, checks.bar_sane(F.col("o"), F.col("h"), F.col("l"), F.col("c")), **v)
    assert not one(spark, checks.bar_sane(F.col("o"), F.col("c"), F.col("l"), F.col("h")), **v)
    assert one(spark, checks.unique(F.array(F.lit(1), F.lit(2))), x=0) and not one(spark, checks.unique(F.array(F.lit(1), F.lit(1))), x=0)
    assert one(spark, checks.identifier_subject(F.lit("lei"), F.lit("entity"), F.lit(None).cast("string")), x=0)
    with pytest.raises(PySparkException):
        checks.require(spark.range(1), F.col("id") > 0, "must be positive").count()


def observed_from(spark, root, content, **facts):
    base = {"provider_namespace": "p", "source_family": "f", "retrieved_at": "2024-09-11 00:00:00", "adapter_version": "1", "retention_class": "public"}
    store.capture(spark, root, content, **(base | facts))
    return adapters.observations(store.manifests(spark, root), "primary_source")


def test_captures_are_stored_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    facts = {"provider_namespace": "p", "source_family": "f", "adapter_version": "1", "retention_class": "public"}
    first = store.capture(spark, root, b"body", retrieved_at="2024-01-01 00:00:00", **facts)
    again = store.capture(spark, root, b"body", retrieved_at="2024-01-01 00:00:00", **facts)
    later = store.capture(spark, root, b"body", retrieved_at="2024-01-02 00:00:00", **facts)
    assert first == again and later["capture_id"] != first["capture_id"]
    assert store.manifests(spark, root).count() == 2 and store.captures(spark, f"{root}/raw/objects").count() == 1
    assert adapters.observations(store.manifests(spark, root), "primary_source").count() == 1
    with pytest.raises(ValueError):
        store.capture(spark, root, b"x", retrieved_at="2024", parameters='{"deep":{"Api_Key":1}}', **facts)
    (tmp_path / "raw/objects" / first["content_sha256"][:2] / first["content_sha256"]).write_bytes(b"other")
    with pytest.raises(files.ConflictError):
        store.capture(spark, root, b"body", retrieved_at="2024-01-03 00:00:00", **facts)


def test_ownership_adapter_end_to_end(spark, tmp_path):
    root = f"file://{tmp_path}"
    observed = observed_from(spark, root, XML.encode()).withColumn("public_time", adapters.temporal_instant(F.to_timestamp(F.lit("2024-09-11 01:30:00")), F.lit("20240910213000"), "America/New_York"))
    one_id = observed.first()["source_observation_id"]
    rows = readers.ownership(spark.createDataFrame([("p", XML)], "path string, text string")).withColumn("source_observation_id", F.lit(one_id))
    typed = store.TypedStore(spark, root)
    found = adapters.ownership_records(rows, observed, typed.load("external_identifiers"))
    made = {n: df for n, df in found.items() if n != "mappings"} | {"source_observations": observed}
    assert {n: df.count() for n, df in made.items()} == {"provenance": 1, "entities": 1, "external_identifiers": 1, "events": 1, "event_evidence": 1, "source_observations": 1}
    event = found["events"].first()
    assert event["event_type"] == "equity_sale" and event["financial_values"][0]["value"] == 100 and {a["name"] for a in event["attributes"]} >= {"unresolved_owners", "reported_price_per_share"}
    assert sorted(r["reason"] for r in found["mappings"].collect()) == ["non_transaction_holding", "unsupported_code"]
    assert all(adapters.persist(typed, made).values()) and not any(adapters.persist(typed, made).values())
    assert graph.integrity({n: typed.load(n) for n in made}, {n: d.key for n, d in records.DATASETS.items()}).count() == 0
    known = typed.load("external_identifiers")
    again = adapters.ownership_records(rows, observed, known)
    assert again["entities"].count() == 0 and again["events"].first()["issuer_entity_id"] == event["issuer_entity_id"]
    changed = made | {"events": found["events"].withColumn("event_type", F.lit("equity_purchase"))}
    with pytest.raises(files.ConflictError, match="nothing was written"):
        adapters.persist(typed, changed)
    two = known.union(known.withColumn("subject_id", F.lit("other")).withColumn("external_identifier_id", F.lit("z")))
    with pytest.raises(PySparkException, match="two entities"):
        adapters.ownership_records(rows, observed, two)["events"].collect()


def test_relationship_adapter(spark, tmp_path):
    body = {"data": [{"type": "relationships", "id": str(i), "attributes": {"entity1_id": 1, "entity2_id": e, "category_id": c, "start_date": "1990-05"}} for i, e, c in ((7, 2, 1), (8, 9, 1), (9, 2, 99))], "included": [{"type": "entities", "id": "1", "attributes": {"name": "a", "primary_ext": "Person"}}, {"type": "entities", "id": "2", "attributes": {"name": "b", "primary_ext": "Org"}}, {"type": "entities", "id": "3", "attributes": {"name": "c", "primary_ext": "Ship"}}]}
    df = spark.createDataFrame([("p", json.dumps(body))], "path string, body string")
    observed = observed_from(spark, f"file://{tmp_path}", b"graph")
    one_id = observed.first()["source_observation_id"]
    edges = readers.relationships(df, adapters.CATEGORIES).withColumn("source_observation_id", F.lit(one_id))
    nodes = readers.graph_nodes(df).withColumn("source_observation_id", F.lit(one_id))
    none = spark.createDataFrame([], records.DATASETS["external_identifiers"].schema)
    accepted = spark.createDataFrame([], "source_id string, semantic_hash string, relationship_id string")
    found = adapters.relationship_records(edges, nodes, observed, none, accepted)
    assert found["entities"].count() == 2 and found["relationships"].count() == 1 and found["relationships"].first()["valid_from"]["precision"] == "month"
    assert sorted(r["reason"] for r in found["mappings"].collect()) == ["unresolved_endpoint", "unsupported_relationship_category", "unsupported_source_entity_type"]
    assert records.violations(found["relationships"], "relationships").count() == 0
    hashes = edges.filter("id = '7'").select(F.col("id").alias("source_id"), "semantic_hash", F.lit("r").alias("relationship_id"))
    assert adapters.relationship_records(edges, nodes, observed, none, hashes)["relationships"].count() == 0
    with pytest.raises(PySparkException, match="has changed"):
        adapters.relationship_records(edges, nodes, observed, none, hashes.withColumn("semantic_hash", F.lit("x")))["relationships"].collect()


@pytest.mark.parametrize("endpoint", adapters.ENDPOINTS)
def test_vendor_adapter(spark, tmp_path, endpoint):
    e = adapters.ENDPOINTS[endpoint]
    row = dict.fromkeys(e["required"], "x") | {e["reported"]: "2024-05-03", "Transaction": "Sale", "Performance": "0.4", e["amount"]: "-5" if not e["trade"] else "1,001"}
    if e["occurrence"]:
        row[e["occurrence"]] = "2024-05-01T00:00:00"
    if "BioGuideID" in row:
        row["BioGuideID"] = "A000001"
    bodies = spark.createDataFrame([("p", json.dumps([row, {"x": "1"}]))], "path string, body string")
    observed = observed_from(spark, f"file://{tmp_path}", b"vendor")
    facts = adapters.vendor_facts(readers.vendor_rows(bodies, e["allowed"]), endpoint).withColumn("source_observation_id", F.lit(observed.first()["source_observation_id"]))
    good, bad = facts.orderBy("row_index").collect()
    assert good["defect"] is None and "Performance" in good["quarantined"] and bad["defect"].startswith("missing_fields:")
    found = adapters.vendor_records(facts, observed, endpoint)
    event = found["events"].first()
    assert event["event_type"] == ("equity_sale" if e["trade"] else e["event"]) and records.violations(found["events"], "events").count() == 0 and found["mappings"].count() == 1
    assert (event["disclosed_ranges"][0]["lower_bound"] == 1001) if e["trade"] else (event["financial_values"][0]["value"] == -5)
    link = facts.filter("row_index = 0").select("row_index", F.lit(event["event_id"]).alias("event_id"), "fact_hash")
    assert adapters.linked_rows(facts, link, found["events"]).filter("event_id IS NOT NULL").count() == 1
    with pytest.raises(PySparkException, match="disagrees"):
        adapters.linked_rows(facts, link.withColumn("fact_hash", F.lit("z")), found["events"]).collect()


def test_synthetic_adapter_and_typed_store(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    observed = observed_from(spark, root, b"invented", provider_namespace="synthetic")
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 2), Decimal("1.50"), observed.first()["source_observation_id"])], "name string, public_day date, amount decimal(18,2), source_observation_id string")
    typed = store.TypedStore(spark, root)
    made = adapters.synthetic_records(rows, observed)
    assert all(adapters.persist(typed, made).values())
    assert {r["dataset"]: r["records"] for r in typed.counts().collect() if r["records"]} == {"source_observations": 1, "provenance": 1, "events": 1, "event_evidence": 1}
    assert typed.inventory().count() == 4 and graph.uncovered_origins(typed.inventory(), typed.inventory()).count() == 0
    assert graph.missing_objects(typed.load("source_observations"), store.captures(spark, f"{root}/raw/objects")).count() == 0
    with pytest.raises(PermissionError):
        store.TypedStore(spark, root, read_only=True).persist("events", made["events"])
    with pytest.raises(ValueError, match="listing_needs_security"):
        typed.persist("events", made["events"].withColumn("listing_id", F.lit("l")).withColumn("event_id", F.lit("z")))
    monkeypatch.setattr(store, "VERSION", "2.0.0")
    with pytest.raises(files.ConflictError, match="part-.*schema_version"):
        typed.load("events")
    assert len(records.documents()) == 11 and not records.drift(records.documents())
    assert records.drift({"x": "1"} | {k: v for k, v in records.documents().items() if not k.startswith("events")}) == {"events.schema.json": "missing", "x": "undeclared"}


def test_constraints_of_outcomes_and_units(spark):
    schema = records.DATASETS["outcomes"].schema
    sound = {"outcome_id": "o", "event_id": "e", "status": "excluded", "exclusion_reason": "x", "horizon_sessions": 60, "schema_version": "1.0.0"}
    cases = [(sound, []), (sound | {"exclusion_reason": None}, ["excluded_has_reason"]), (sound | {"status": "complete", "exclusion_reason": None}, ["complete_has_all"]), (sound | {"security_return": Decimal(1)}, ["others_have_no_return"]), (sound | {"listing_id": "l"}, ["listing_needs_security"]), (sound | {"status": "right_censored", "exclusion_reason": None}, ["censored_has_entry"]), (sound | {"entry_price": Decimal(1)}, ["entry_in_pairs", "prices_have_sources"])]
    rows = spark.createDataFrame([tuple((c | {"outcome_id": str(i)}).get(f) for f in schema.fieldNames()) for i, (c, _) in enumerate(cases)], schema)
    found = {r["outcome_id"]: r["broken"] for r in records.violations(rows, "outcomes").collect()}
    assert found == {str(i): want for i, (_, want) in enumerate(cases) if want}
    unit = lambda kind, money, what: one(spark, checks.financial_units(F.struct(F.lit(kind).alias("kind"), F.lit(money).cast("string").alias("currency"), F.lit(what).cast("string").alias("unit"))), x=0)
    assert unit("monetary_amount", "USD", None) and not unit("monetary_amount", "USD", "x") and unit("unit_price", "USD", "x") and unit("quantity", None, "x") and not unit("percentage", "USD", None) and not unit("monetary_amount", "usd", None)
    assert one(spark, checks.availability_coherent(F.lit("exact"), F.lit(1), F.lit(1), F.lit(None)), x=0) and not one(spark, checks.availability_coherent(F.lit("unsupported"), F.lit(1), F.lit(1), F.lit(None)), x=0)
    assert one(spark, checks.actionable_coherent(F.lit("exact"), F.lit(1), F.lit(1)), x=0) and not one(spark, checks.actionable_coherent(F.lit("exact"), F.lit(None), F.lit(1)), x=0)
    assert one(spark, checks.eligibility_coherent(F.lit(True), F.lit("eligible")), x=0)


def test_temporal_values_and_policies(spark):
    flat = "struct<raw_value:string,precision:string,year:int,month:int,day:int,timestamp:timestamp,source_timezone:string>"
    at = dt.datetime(2024, 5, 1, 10, 0)
    cases = [(("2024-05", "month", 2024, 5, None, None, None), True), (("2024-05", "day", 2024, 5, 1, None, None), False), (("2024-05-01", "day", 2024, 5, 1, None, "UTC"), False), (("2023-02-30x", "day", 2023, 2, 30, None, None), False), (("2024-05-01T12:00:00+02:00", "second", None, None, None, at, "x"), True), (("2024-05-01T12:00:00Z", "second", None, None, None, at, "x"), False), (("soon", "unknown", None, None, None, None, None), True)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], f"v {flat}")
    assert [r["ok"] for r in rows.select(checks.temporal_value(F.col("v")).alias("ok")).collect()] == [w for _, w in cases]
    got = [tuple(r["a"]) for r in rows.select(temporal.available(F.col("v"), F.lit(60)).alias("a")).collect()]
    assert got[4] == ("exact", dt.datetime(2024, 5, 1, 10, 1), None, None) and got[0] == ("unsupported", None, None, "delay_on_coarse_time")
    assert one(spark, temporal.normalized_utc(F.col("x")), x="2024-05-01T12:00:00+02:00") == at and one(spark, temporal.normalized_utc(F.col("x")), x="2024-05-01T12:00:00") is None
    assert one(spark, temporal.calendar_day(F.struct(F.lit("day").alias("precision"), F.lit(2024).alias("year"), F.lit(5).alias("month"), F.lit(1).alias("day"), F.lit(None).cast("timestamp").alias("timestamp"))), x=0) == dt.date(2024, 5, 1)
    assert not one(spark, parse.same_occurrence(F.struct(F.lit("unknown").alias("precision"), *(F.lit(None).alias(c) for c in ("year", "month", "day", "timestamp"))), F.struct(F.lit("unknown").alias("precision"), *(F.lit(None).alias(c) for c in ("year", "month", "day", "timestamp")))), x=0)
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("lower"), F.lit(b).cast("int").alias("upper"))
    assert one(spark, parse.same_range(span(1, None), span(1, None)), x=0) and not one(spark, parse.same_range(span(None, None), span(None, None)), x=0)
    assert one(spark, parse.range_defect(F.lit("$9 - $5"), F.lit(None)), x=0) == "inverted_range" and one(spark, parse.range_defect(F.lit("$5 - $9"), F.lit(10)), x=0) == "amount_outside_range"
    for text, secret in (('{"a":{"b":[{"Client-Secret":1}]}}', True), ('{"u":"https://me:pw@host/x"}', True), ('{"u":"https://host/x?apikey=1"}', True), ('{"u":"https://host/x?page=1"}', False)):
        assert one(spark, parse.has_secret_key(F.col("x")), x=text) == secret == parse.names_secret(json.loads(text))
    kinds = spark.createDataFrame([("Purchase",), ("SALE (Partial)",), ("gift",)], "k string").select(readers.transaction_kind(F.col("k")).alias("t")).collect()
    assert [r["t"] for r in kinds] == ["equity_purchase", "equity_sale", None]
    rows = spark.createDataFrame([(1, None, "é")], "b int, a string, c string")
    assert rows.select(ids.content_hash("a", "b", "c")).first()[0] == hashlib.sha256('{"a":null,"b":1,"c":"é"}'.encode()).hexdigest()


def test_features_leak_nothing(spark):
    known = lambda i, day: (f"f{i}", ("day", 2024, 5, day, None))
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 3), [known(1, 1), known(2, 2), known(3, 3)]), (dt.datetime(2024, 5, 9), [known(1, 1)])], "snapshot_at timestamp, features array<struct<feature_value_id:string,known_from:struct<precision:string,year:int,month:int,day:int,timestamp:timestamp>>>")
    got = rows.select(F.size(features.eligible_at(F.col("features"), F.col("snapshot_at"))).alias("n"), features.leaked(F.col("features"), F.col("snapshot_at")).alias("bad")).collect()
    assert [tuple(r) for r in got] == [(2, ["f3"]), (1, [])]
    assert features.guarded(rows.filter("day(snapshot_at) = 9")).count() == 1
    with pytest.raises(PySparkException, match="f3"):
        features.guarded(rows).collect()


def test_calendar_preconditions_and_contracts(spark):
    cal = calendars.new_york_sessions(spark, "2024-06-01", "2024-07-31")
    assert assembly.completed_coverage(cal, "2024-07-04", "2024-07-10 00:00:00") == "coverage_is_no_session"
    assert assembly.completed_coverage(cal, "2024-07-03", "2024-07-03 16:59:00") == "coverage_session_not_completed" and assembly.completed_coverage(cal, "2024-07-03", "2024-07-03 17:00:00") is None
    assert assembly.embargo_sessions(cal, "2024-07-01", "2024-07-08") == 3
    assert assembly.latest_completed(cal, F.to_timestamp(F.lit("2024-07-03 16:00:00"))).first()[0] == dt.date(2024, 7, 2)
    bars = spark.createDataFrame([("s", "l", dt.date(2024, 7, 1), 1.0, 2.0, 1.0, 2.0, v, "p", "f", "raw") for v in (5, 5)], "security_id string, listing_id string, session_date date, open double, high double, low double, close double, volume int, provider string, feed string, adjustment string")
    assert assembly.listing_prices(bars).count() == 1 and assembly.price_contract(bars, "p", "f", "raw").count() == 2
    with pytest.raises(PySparkException, match="two different"):
        assembly.listing_prices(bars.union(bars.withColumn("volume", F.lit(6)))).collect()
    with pytest.raises(PySparkException, match="another provider"):
        assembly.price_contract(bars, "q", "f", "raw").collect()
    missing = spark.createDataFrame([(1, ["a"])], "event_id int, observation_ids array<string>")
    with pytest.raises(PySparkException, match="observation that is missing"):
        assembly.supported(spark.createDataFrame([(1,)], "event_id int"), missing, spark.createDataFrame([], "observation_id string, family string, role string, public string")).collect()


def protocol(**change):
    base = dict(hypothesis_id="h", version="1", event_types=("a",), source_families=("f",), features=("x",), feature_definitions=("x",), discovery=("2020-01-01", "2020-12-31"), validation=("2022-01-01", "2022-12-31"))
    return control.Protocol(**(base | change))


def config(**change):
    return control.BuildConfig(**(dict(mode="validation", period=("2022-01-01", "2022-12-31"), as_of="2023-06-01", coverage_through="2023-05-01", features=("x",)) | change))


def test_registration_and_approval(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    p = protocol()
    args = (spark, registry, p, "origins", "code")
    with pytest.raises(control.NotApproved):
        control.require_registration(*args)
    with pytest.raises(control.NotApproved):
        control.register(*args, approval="", uninspected=True, at="t")
    first = control.register(*args, approval="r1", uninspected=True, at="t1")
    assert control.register(*args, approval="r1", uninspected=True, at="t2") == first == control.require_registration(*args)
    with pytest.raises(files.ConflictError):
        control.register(*args, approval="r2", uninspected=True, at="t")
    early = control.start_attempt(spark, registry, "s0", p, config(mode="discovery", period=("2020-01-01", "2020-12-31"), coverage_through="2022-02-01"), "t")
    other = protocol(version="2")
    with pytest.raises(control.NotApproved, match="inspected"):
        control.register(spark, registry, other, "origins", "code", approval="r", uninspected=True, at="t")
    control.finish_attempt(spark, registry, early, inspected=True, success=True, at="t", period=("2020-01-01", "2021-03-01"))
    assert control.register(spark, registry, other, "origins", "code", approval="r", uninspected=True, at="t")
    seen = control.inspections(spark, registry)
    assert [tuple(map(str, r))[2:] for r in seen.collect()] == [("2020-01-01", "2021-03-01")]
    assert control.lost_inspections(seen, seen).count() == 0 and control.lost_inspections(seen, seen.limit(0)).first()["problem"] == "removed"
    assert control.lost_inspections(seen, seen.withColumn("last", F.date_sub("last", 9))).first()["problem"] == "downgraded"
    scope = {k: k for k in control.APPROVED} | {"snapshot_id": "s1", "protocol_sha256": p.digest, "registry": registry}
    attempt = control.start_attempt(spark, registry, "s1", p, config(), "t")
    with pytest.raises(control.NotApproved, match="no reviewed history"):
        control.require_approval(spark, registry, dict(scope), scope, attempt)
    history = {n: files.sha256(files.read(spark, f"{registry}/attempts/{n}")) for n in files.listed(spark, f"{registry}/attempts") if n.startswith(early)}
    control.require_approval(spark, registry, scope | {"preserved_history": history}, scope, attempt)
    with pytest.raises(control.NotApproved, match="plan_sha256"):
        control.require_approval(spark, registry, scope | {"plan_sha256": "other"}, scope, attempt)
    with pytest.raises(control.NotApproved, match="history"):
        control.require_approval(spark, registry, scope | {"preserved_history": dict.fromkeys(history, "0")}, scope, attempt)
    second = control.start_attempt(spark, registry, "s1", p, config(), "t")
    control.scope_attempt(spark, registry, attempt, scope["plan_sha256"], None)
    control.require_approval(spark, registry, scope | {"preserved_history": history}, scope, second)


def test_declarations_that_contradict_themselves(spark):
    for change in ({"discovery": ("2020-01-01", "2022-01-01")}, {"feature_definitions": ()}, {"horizons": (20, 60)}, {"validation": ("2023-01-01", "2022-01-01")}):
        with pytest.raises(ValueError):
            protocol(**change)
    for change in ({"horizons": (20, 60, 90, 7)}, {"horizons": (20, 60, 90, 90)}, {"benchmark_security_id": "s"}, {"period": ("2", "1")}, {"features": ("x", "x")}):
        with pytest.raises(ValueError):
            config(**change)
    bindings = spark.createDataFrame([(1,), (1,), (2,)], "event_id int")
    controls = spark.createDataFrame([(1, dt.date(2024, 1, 1), None), (2, None, None)], "event_id int, terminal_date date, terminal_observation_id string")
    assert sorted(map(tuple, control.control_defects(bindings, controls).collect())) == [(1, "repeated_binding"), (1, "terminal_without_date_or_evidence")]
    kinds = lambda *k: spark.createDataFrame([(x,) for x in k], "retention_class string")
    assert control.rights_defect(kinds("public"), config(), False) is None and "output_rights" in control.rights_defect(kinds("public", "unknown"), config(), True)
    free = config(output_rights="private_only", restricted_raw_retention_permitted=True, restricted_derivatives_permitted=True, license_review_reference="r")
    assert control.rights_defect(kinds("restricted"), free, True) is None and control.rights_defect(kinds("restricted"), free, False) == "restricted sources without private_root"


def test_results_are_verified_by_recomputation(spark):
    again = spark.createDataFrame([(i, h, "complete") for i in range(3) for h in (20, 60)], "event_id int, horizon int, status string")
    assert control.verified_result(again, again, ["event_id", "horizon"]).count() == 0
    stored = again.filter("event_id <> 2 OR horizon <> 60").withColumn("status", F.when(F.col("event_id") == 0, "rejected").otherwise(F.col("status"))).union(spark.createDataFrame([(9, 20, "x")], again.schema))
    assert sorted(map(tuple, control.verified_result(stored, again, ["event_id", "horizon"]).collect())) == [(0, 20, "changed"), (0, 60, "changed"), (2, 60, "missing"), (9, 20, "unexpected")]
    events = again.select("event_id").distinct()
    assert control.incomplete_inventory(again, events, (20, 60)).count() == 0 and control.incomplete_inventory(stored.union(stored.filter("event_id = 1 AND horizon = 20")), events, (20, 60)).count() == 3


def test_archives_layouts_and_generations(spark, tmp_path):
    root, archive = f"file://{tmp_path}/root", f"file://{tmp_path}/archive"
    for name in ("plans/a.json", "approvals/a.json", "rows.md"):
        files.write_once(spark, f"{root}/{name}", name.encode())
    sealed = control.seal(spark, root, archive)
    pair = ((r"plans/(.*)\.json", "approvals/{}.json"),)
    assert control.archive_defects(spark, root, archive, sealed, pair) == [] and control.archive_defects(spark, root, archive, "0" * 64) == ["manifest"]
    files.write_once(spark, f"{root}/plans/b.json", b"b")
    files.remove(spark, f"{root}/rows.md")
    assert control.archive_defects(spark, root, archive, sealed, pair) == ["alone plans/b.json", "missing rows.md", "undeclared plans/b.json"]
    allowed = (r"plans/.*", r"approvals/.*")
    assert control.layout_defects(spark, root, allowed) == [] and control.layout_defects(spark, root, allowed[:1]) == ["not_allowed approvals/a.json"]
    assert control.layout_defects(spark, root, allowed, control.Bounds(file_bytes=2, total_bytes=5, files=1)) == ["too_large approvals/a.json", "too_large plans/a.json", "too_many_bytes", "too_many_files"]
    held = files.ObjectStore(spark, f"file://{tmp_path}/store")
    first = control.publish(held, root, None, allowed)
    assert control.publish(held, root, first, allowed) == first and control.head(held)[0] == first
    with pytest.raises(files.ConflictError, match="current"):
        control.publish(held, root, None, allowed)
    files.write_once(spark, f"{root}/plans/c.json", b"c")
    second = control.publish(held, root, first, allowed)
    assert control.restore(held, f"file://{tmp_path}/again") == second
    assert files.listed(spark, f"file://{tmp_path}/again") == files.listed(spark, root)
    assert control.restore(held, f"file://{tmp_path}/old", first) == first and len(files.listed(spark, f"file://{tmp_path}/old")) == 3
    third = control.run_pipeline(held, f"file://{tmp_path}/work", lambda w: files.write_once(spark, f"{w}/plans/d.json", b"d"))
    assert control.load_generation(held, third)["parent"] == second
    files.remove(spark, f"{root}/plans/a.json")
    with pytest.raises(files.ConflictError, match="gone"):
        control.publish(held, root, third, allowed)
    with pytest.raises(files.ConflictError):
        held.put("current.json", b"x", "wrong tag")
    with pytest.raises(ValueError):
        held.put("../x", b"x")
    assert [files.safe_path(p) for p in ("a/b.json", "a/../b", "/a", "con", "a/.b", "a b", "")] == [True] + [False] * 6


def test_audits_and_reports(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("j", i, f"r{i}", s, base + dt.timedelta(seconds=i * gap) if s != "unattempted" else None, "h" if s == "captured" else None, 3 if s == "captured" else None) for i, (s, gap) in enumerate((("captured", 1), ("captured", 1), ("failed", 1), ("unattempted", 1)))]
    schema = "journal string, position int, request_id string, state string, attempted_at timestamp, sha256 string, length long"
    journal = spark.createDataFrame(rows, schema)
    assert audits.receipt_defects(journal).count() == 0
    late = spark.createDataFrame([*rows, ("j", 9, "r9", "captured", base + dt.timedelta(seconds=9), "h", 3)], schema)
    assert [tuple(r) for r in audits.receipt_defects(late).collect()] == [("r9", "attempt_after_failure")]
    stated = spark.createDataFrame([("j", 2, 1, 1, 6)], "journal string, captured long, failed long, unattempted long, bytes long")
    assert audits.receipt_totals(journal, stated).count() == 0 and audits.receipt_totals(late, stated).count() == 2
    objects = spark.createDataFrame([("h", 3)], "sha256 string, length long")
    assert audits.missing_objects(journal, objects).count() == 0 and audits.missing_objects(journal, objects.limit(0)).count() == 2
    assert audits.duplicate_excess(spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int")).first()[0] == 2
    table = spark.createDataFrame([(60, 3, None), (20, 5, 2)], "horizon int, n int, mean int")
    first, again = (audits.report("Study", {"events": 8}, {"status": (df, ["horizon", "n", "mean"], ["horizon"])}) for df in (table, table.repartition(3)))
    assert first == again and "| 20 | 5 | 2 |\n| 60 | 3 | unavailable |" in first[1].decode() and json.loads(first[0])["tables"]["status"][1]["mean"] is None
    derive = lambda df: audits.counters(df, "state")
    made, _ = audits.regenerated(journal, derive)
    assert audits.regenerated(journal, derive, made)[1] and not audits.regenerated(late, derive, made)[1]


def test_exact_reports(spark):
    rows = spark.createDataFrame([("a", v) for v in range(1, 12)] + [("b", -1), ("b", 2), ("c", None)], "g string, v long")
    got = reports.exact_distribution(rows, "g", "v", 10)
    assert got["a"] == {"n": 11, "mean": Decimal("0.6"), "median": Decimal("0.6"), "minimum": Decimal("0.1"), "maximum": Decimal("1.1"), "p10": Decimal("0.2"), "p90": Decimal("1"), "positive_fraction": 1}
    assert got["b"]["median"] == Decimal("0.05") and got["b"]["positive_fraction"] == Decimal("0.5") and "c" not in got
    assert reports.count_map(rows.withColumn("k", F.col("v") % 2), "g", "k").orderBy("g").first()["counts"] == {"0": 5, "1": 6}


def test_listing_resolution_by_knowledge(spark):
    rows = spark.createDataFrame([(1, 10, True, True), (2, 20, True, False), (3, 30, None, True), (4, 40, True, True), (4, 41, None, True), (5, 50, False, True), (6, None, None, None), (7, 70, True, True), (7, 71, True, True)], "r int, l int, holds boolean, known boolean")
    got = {x["r"]: (x["outcome"], x["reason"], x["l"]) for x in identity.resolve_listing(rows, "r", "l", F.col("holds"), F.col("known")).collect()}
    assert got == {1: ("resolved", "exact", 10), 2: ("unresolved", "not_known_at_time", None), 3: ("unresolved", "coarse_validity", 30), 4: ("ambiguous", "coarse_validity", None), 5: ("unresolved", "no_match", None), 6: ("unresolved", "no_match", None), 7: ("ambiguous", "multiple_matches", None)}


def test_paged_answers(spark):
    body = lambda token, symbol="A", t="2024-07-03T04:00:00Z": json.dumps({"bars": {symbol: [{"t": t}]}, "next_page_token": token})
    days = (dt.date(2024, 7, 1), dt.date(2024, 7, 9))
    pages = [("ok", 1, None, body("x")), ("ok", 2, "x", body(None)), ("open", 1, None, body("x")), ("twice", 1, None, body("x")), ("twice", 2, "x", body("x")), ("twice", 3, "x", body(None)), ("chain", 1, None, body("x")), ("chain", 2, "y", body(None)), ("symbol", 1, None, body(None, "B")), ("day", 1, None, body(None, t="2024-08-01T04:00:00Z")), ("bad", 1, None, "{")]
    df = spark.createDataFrame([(*p, "A", *days) for p in pages], "request_id string, position int, page_token string, body string, symbol string, first_day date, last_day date")
    assert sorted(map(tuple, readers.page_defects(df).collect())) == [("bad", "unreadable_page"), ("chain", "broken_chain"), ("day", "bar_outside_request"), ("open", "pages_missing"), ("symbol", "other_symbol"), ("twice", "repeated_token")]


def test_evidence_and_prepared_inputs(spark, tmp_path):
    root, content = f"file://{tmp_path}", b"The share class BBG000000001 of an issuer."
    observed = observed_from(spark, root, content)
    span = {"start": 16, "end": 28, "text": "BBG000000001", "subject_type": "security", "subject_id": "s", "identifier_type": "figi_share_class", "known_day": "2024-05-01"}
    claim = adapters.evidence_claims(spark, content, files.sha256(content), [span], observed)
    assert claim.first()["known_from"]["precision"] == "day" and records.violations(claim, "external_identifiers").count() == 0
    for bad in ((content + b".", [span]), (content, [span | {"start": 15}])):
        with pytest.raises(ValueError):
            adapters.evidence_claims(spark, bad[0], files.sha256(content), bad[1], observed)
    typed = store.TypedStore(spark, root)
    typed.persist("external_identifiers", claim)
    with pytest.raises(FileNotFoundError, match="protocol"):
        store.read_inputs(spark, root)
    for name in store.DOCUMENTS:
        files.write_once(spark, f"{root}/{name}.json", b"{}")
    claim.write.parquet(f"{root}/staging/bundles")
    inputs = store.read_inputs(spark, root)
    assert inputs.inventory.count() == 1 and list(inputs.staging) == ["bundles"] and len(inputs.datasets) == 11
    assert typed.views() == sorted(records.DATASETS) and tables.query(spark, "SELECT value FROM external_identifiers WHERE subject_id = ?", "s").first()[0] == "BBG000000001"


def test_ancestors_have_no_row_limit(spark):
    edges = spark.range(1, 200_001).selectExpr("id AS node", "CASE WHEN id >= 2 THEN id DIV 2 END AS parent")
    assert lineage.ancestors(spark, edges).count() == sum((200_000 - 2**k + 1) for k in range(18))


def test_views_and_parameters(spark):
    assert "orders" in tables.register_views(spark, "/root/testdata/sf0.001")
    assert tables.query(spark, "SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", 0).first()["n"] == 5


def test_streaming_and_entry_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_bootstrap_is_brute_force_with_5000(spark, monkeypatch):
    from keelson.plans import study

    groups = [(0, 3, 900, 1, -50), (1, 1, 40, 0, 0), (2, 0, 0, 2, 700), (3, 2, -300, 2, 10), (4, 5, 1250, 1, 333)]
    monkeypatch.setattr(study, "issuer_clusters", lambda s, d: spark.createDataFrame(groups, "idx int, p_n long, p_sum long, s_n long, s_sum long"))
    found, missing = [], 0
    for r in range(5000):
        picked = []
        for k in range(r * 5, r * 5 + 5):
            message = b"cluster-draws" + study.SEED.to_bytes(8, "big") + k.to_bytes(8, "big")
            picked.append(groups[int.from_bytes(hashlib.sha256(message).digest()[:8], "big") % 5])
        pn, ps, sn, ss = (sum(g[i] for g in picked) for i in (1, 2, 3, 4))
        if pn and sn:
            found.append(ps / pn - ss / sn)
        else:
            missing += 1
    found.sort()
    n = len(found)
    row = study.q29_bootstrap(spark, "").first()
    assert tuple(row) == (5000, missing, round(found[(n + 39) // 40 - 1]), round(found[(39 * n + 39) // 40 - 1]))


def test_the_verdict_gathers_no_issuers(spark, monkeypatch):
    from keelson.plans import study

    seen, stored, summaries = [], study.lineage.stored, inference.arm_summaries
    monkeypatch.setattr(study.lineage, "stored", lambda df: seen.append(df.columns) or stored(df))
    monkeypatch.setattr(inference, "arm_summaries", lambda *a, **b: seen.append((df := summaries(*a, **b)).columns) or df)
    monkeypatch.setattr(inference, "resampled", lambda groups, *_: groups.withColumnRenamed("idx", "resample"))
    assert study.q30_verdict(spark, "/root/testdata/sf0.001").count() == 1
    rows, arms = seen
    assert set(rows) == {"horizon", "event_type", "selection", "timing_eligible", "status", "issuer_id", "excess_ppm"}
    assert "issuer_counts" not in arms and {"complete", "issuers", "actionable", "total", "largest"} <= set(arms)


def test_events_outside_of_the_calendar_raise(spark):
    from datetime import date

    rows = [(1, date(1995, 1, 1)), (2, date(2002, 12, 31)), (3, None)]
    events = spark.createDataFrame(rows, "event_id int, public_date date")
    assert calendars.covered(events, F.col("public_date")).count() == 3
    late = events.union(spark.createDataFrame([(4, date(2003, 1, 2))], events.schema))
    with pytest.raises(Exception, match="outside of the calendar"):
        calendars.covered(late, F.col("public_date")).collect()
    assert calendars.covered(late, F.col("public_date"), last="2003-12-31").count() == 4
    assert calendars.covered(events.limit(0), F.col("public_date")).count() == 0
