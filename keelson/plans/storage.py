"""Queries on what is stored: paged bars, digest trees, upserts by bucket and bodies taken apart."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodies
from ..session import shared_folder
from ..sources import captures, datasets, regeneration
from ..streaming import first_seen_stream, latest
from ..tables import daily_bars, table
from .common import BAR, register

RENAMED, ASKED, PAGE = dt.date(1995, 7, 1), (dt.date(1993, 1, 1), dt.date(1997, 12, 31)), 100


@register(f"""WITH {BAR}, b AS (SELECT security_id, d, CASE WHEN d < DATE '{RENAMED}' THEN 'A' ELSE 'B' END AS part, CAST(open * 100 AS BIGINT) AS open_cents, CAST(close * 100 AS BIGINT) AS close_cents, n FROM bar WHERE d BETWEEN DATE '{ASKED[0]}' AND DATE '{ASKED[1]}')
SELECT 'L' || security_id AS listing_id, 'S' || security_id || part AS symbol, CAST(d AS VARCHAR) AS session_date, open_cents, close_cents, n AS volume, CAST((row_number() OVER (PARTITION BY security_id, part ORDER BY d) - 1) // {PAGE} AS INTEGER) AS page
FROM b QUALIFY d BETWEEN DATE '1994-03-01' AND DATE '1997-03-01'""")
def q71_paged_bars(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's bars, captured as pages under a symbol that changes in 1995, and read back through their chains."""
    root = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    bars = daily_bars(spark, d)
    listings = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())
    symbols = [(f"L{i}", f"S{i}{part}", a, b) for i in listings for part, a, b in (("A", dt.date(1990, 1, 1), RENAMED), ("B", RENAMED, None))]
    asked = captures.segments(symbols, *ASKED)
    names = spark.createDataFrame([(s.listing_id, s.symbol, str(s.first), str(s.last)) for s in asked], "listing_id string, symbol string, first string, last string")
    rows = bars.join(F.broadcast(names), (F.concat(F.lit("L"), "security_id") == F.col("listing_id")) & F.col("session_date").between(F.to_date("first"), F.to_date("last")))
    pages = captures.bar_bodies(rows.select("symbol", "first", "last", "session_date", "open", F.col("close").alias("high"), F.col("open").alias("low"), "close", F.col("n").alias("volume")), PAGE)
    # a nation without a bar has no page: an empty one says so
    empty = names.join(rows.select("symbol").distinct(), "symbol", "left_anti").select(F.concat_ws("_", "symbol", "first", "last").alias("collection"), F.lit("").alias("name"), F.encode(F.lit('{"bars":{},"next_page_token":null}'), "UTF-8").alias("content"), F.to_json(F.struct("symbol", "first", "last")).alias("parameters"))
    captures.capture_rows(pages.unionByName(empty), root, retrieved_at="2024-01-01T00:00:00Z")
    found = captures.listing_bars(captures.paged(spark, root, asked).filter("session_date BETWEEN DATE '1994-03-01' AND DATE '1997-03-01'"))
    cents = lambda c: (F.col(c) * 100).cast("bigint").alias(f"{c}_cents")
    return found.select("listing_id", "symbol", F.col("session_date").cast("string").alias("session_date"), cents("open"), cents("close"), "volume", "page")


_TREE = """SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS p2, sha256(concat_ws('|', o_orderkey, o_custkey, {status}, CAST(CAST(o_orderdate AS DATE) AS VARCHAR))) AS h FROM orders"""


def _tree_sql(name: str, status: str) -> str:
    return f"""{name}r AS ({_TREE.format(status=status)}), {name}2 AS (SELECT p2 AS prefix, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM {name}r GROUP BY 1),
{name}1 AS (SELECT substr(prefix, 1, 1) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM {name}2 GROUP BY 1),
{name}0 AS (SELECT '' AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM {name}1),
{name} AS (SELECT 2 AS level, * FROM {name}2 UNION ALL SELECT 1, * FROM {name}1 UNION ALL SELECT 0, * FROM {name}0)"""


@register(f"""WITH {_tree_sql('a', 'o_orderstatus')}, {_tree_sql('b', "CASE WHEN o_orderkey % 1009 = 0 THEN '?' ELSE o_orderstatus END")}
SELECT level, prefix, a.n AS rows, a.digest, a.digest <> b.digest AS changed FROM a JOIN b USING (level, prefix)""")
def q72_digest_tree(spark: SparkSession, d: str) -> DataFrame:
    """The digest tree of all orders, and which of its nodes differ from that of a copy with some orders altered."""
    orders = table(spark, d, "orders")

    def tree(status) -> DataFrame:
        row = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), status, F.col("o_orderdate").cast("date").cast("string"))
        return datasets.digest_tree(orders, ["o_orderkey"], 2, row, F.col("o_orderkey").cast("string"))

    stated = tree(F.col("o_orderstatus"))
    altered = tree(F.when(F.col("o_orderkey") % 1009 == 0, "?").otherwise(F.col("o_orderstatus")))
    changed = datasets.tree_differences(stated, altered).select("level", "prefix", F.lit(True).alias("changed"))
    return stated.join(changed, ["level", "prefix"], "left").select("level", "prefix", "rows", "digest", F.coalesce("changed", F.lit(False)).alias("changed"))


@register("""SELECT o_orderkey AS k, o_orderstatus AS v, o_orderdate >= TIMESTAMP '1997-01-01' AS late FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderdate >= TIMESTAMP '1997-01-01'""")
def q73_bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders stored by three upserts that share records, read back from the newest version of every bucket."""
    path = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    late = F.to_date("o_orderdate") >= F.lit("1997-01-01")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), late.alias("late"))
    for part in (rows.filter("k % 3 = 0"), rows.filter("k % 3 <> 1"), rows.filter("late OR k % 6 = 0")):
        datasets.upsert(spark, path, part, "k", F.to_json(F.struct("k", "v", "late")))
    return datasets.read_dataset(spark, path, rows.schema)


@register(r"""WITH t AS (SELECT click_id, unnest(j) AS j FROM (SELECT click_id, (SELECT list(x) FROM json_tree(props) x) AS j FROM clicks WHERE json_valid(props))),
w AS (SELECT click_id, replace(regexp_replace(substr(j.fullkey, 2), '\[[0-9]+\]', '/*', 'g'), '.', '/') AS place, CASE j.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, json_extract_string(j.atom, '$') AS value, CAST(j.value AS VARCHAR) IN ('{}', '[]', '""') AS empty FROM t)
SELECT place, type, count(*) AS n, count(DISTINCT click_id) AS bodies, count(*) FILTER (WHERE empty) AS empty, count(DISTINCT value) AS "distinct" FROM w GROUP BY 1, 2""")
def q74_body_places(spark: SparkSession, d: str) -> DataFrame:
    """What each place of the clicks' JSON bodies holds."""
    walked = bodies.walk(table(spark, d, "clicks"), "click_id", "props")
    return bodies.place_statistics(walked, "click_id")


@register("""SELECT coalesce(json_extract_string(props, '$.device.os'), 'none') AS key, count(*) AS n, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total FROM clicks WHERE json_valid(props) GROUP BY 1""")
def q75_regeneration(spark: SparkSession, d: str) -> DataFrame:
    """Clicks by operating system, regenerated from captured bodies in two runs, of which the second derives only what came since."""
    root = f"{shared_folder(spark)}/regenerated-{uuid.uuid4().hex}"
    part = F.floor(F.col("click_id") / 500).cast("string")
    rows = table(spark, d, "clicks").filter("props IS NOT NULL").groupBy(part.alias("name")).agg(F.encode(F.array_join(F.array_sort(F.collect_list("props")), "\n"), "UTF-8").alias("content"))
    rows = rows.select(F.lit("clicks").alias("collection"), "name", "content", F.lit(None).cast("string").alias("parameters"))

    def derive(found: DataFrame) -> DataFrame:
        lines = found.select("digest", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
        lines = lines.select("digest", F.try_parse_json("line").alias("v")).filter("v IS NOT NULL")
        return lines.groupBy("digest", F.coalesce(F.try_variant_get("v", "$.device.os", "string"), F.lit("none")).alias("key")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(0))).alias("total"))

    for chosen in (F.col("name").cast("int") % 2 == 0, F.lit(True)):
        captures.capture_rows(rows.filter(chosen), root)
        run = regeneration.regenerate(spark, root, f"{root}/report", derive)
    return run.report.select("key", "n", F.col("total").cast("bigint").alias("total"))


@register("WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k, min(event_type) OVER (PARTITION BY user_id) <> max(event_type) OVER (PARTITION BY user_id) AS conflict FROM events) SELECT user_id, event_type, conflict FROM w WHERE k = 1")
def q76_first_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and whether others differ from it, as a stream that keeps state tells them."""
    folder = f"{shared_folder(spark)}/first-seen-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    # a pattern, as a stream takes a folder or a pattern, and the table may be a file
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]").select("user_id", "event_type", "ts")
    first_seen_stream(rows, "user_id", "ts", "event_type", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return latest(spark.read.parquet(f"{folder}/out"), "user_id").select("user_id", "event_type", "conflict")
