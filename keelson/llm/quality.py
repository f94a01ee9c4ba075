"""Quality rules: base counts of each text and cross-document line frequency, in DataFrame functions alone.

Lines are normalised (lower case, digits alike, white space single) and hashed; a line that more documents
of its host (source) have than the limit is removed, and a document whose words it depletes is rejected.
The limit is ``most`` documents of a host, whatever its size: text that so many pages of one host share is
a template's, and a large host doesn't earn its boilerplate more room. A document is depleted when fewer than ``words_left`` words, or less than ``share_left`` of its words, stay.

Edge cases: a null or empty text has no words and fails the base rules; null is a host of its own; lines
without a word don't count; a line that a document repeats counts once for it, and all its occurrences are
removed; repeated rows count as documents and are each reported; a null doc_id keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"

MOST, WORDS_LEFT, SHARE_LEFT = 20, 50, 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), GAP, " ")))


def host_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def base_counts(docs: DataFrame) -> DataFrame:
    """The contract's counts; a column used twice comes from a select of its own, so that it is computed once."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host_of(F.col("source")).alias("host"), text.alias("text"))
    rows = rows.select("doc_id", "host", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("its_text"),
        F.size("hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"),
        F.when(F.size("hashes") >= 3, F.array_sort(F.transform(F.slice("hashes", 1, F.size("hashes") - 2), lambda h, i: F.struct(F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("gram"), i.alias("at"))))).alias("grams"),
    )
    same = lambda x, i, d: F.get("grams", i + d)["gram"] == x["gram"]
    twice = F.filter("grams", lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
    rows = rows.withColumn("twice", F.array_sort(F.transform(twice, lambda x: x["at"]))).drop("grams")
    covered = F.aggregate(F.transform("twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("twice", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("twice")


def frequent_lines(docs: DataFrame, most: int) -> DataFrame:
    """(host, line): lines in more than ``most`` documents of their host."""
    rows = docs.select(host_of(F.col("source")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("host", "line", F.lit(True).alias("frequent"))


def quality(docs: DataFrame, most: int = MOST, words_left: int = WORDS_LEFT, share_left: float = SHARE_LEFT) -> DataFrame:
    """The base counts, the words that stay when frequent lines go, and the verdict, for each document."""
    key = ["doc_id", "its_text", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lines = base_counts(docs).select(*key, F.posexplode_outer("lines").alias("at", "one"))
    lines = lines.select(*key, F.col("one.line").alias("line"), F.col("one.words").alias("words"), F.coalesce(F.col("at") == 0, F.lit(True)).alias("first"))
    joined = lines.join(frequent_lines(docs, most), ["host", "line"], "left")
    rows = joined.groupBy(*key).agg(F.sum(F.when(F.col("frequent"), F.col("words")).otherwise(0)).alias("removed"), F.sum(F.col("first").cast("int")).alias("rows"))
    left = F.col("n_words") - F.col("removed") / F.col("rows")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.select(*key, left.cast("long").alias("words_left"), failed.alias("base_failed"), "rows")
    kept = ~F.col("base_failed") & (F.col("words_left") >= words_left) & (F.col("words_left") >= share_left * F.col("n_words"))
    out = out.withColumn("kept", kept).withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", *key[3:], "base_failed", "kept", "words_left")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1) GROUP BY k),
l AS (SELECT k, host, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{GAP}', ' ', 'g')) AS norm FROM (SELECT k, host, unnest(lines) AS line FROM w)),
f AS (SELECT host, norm FROM l GROUP BY ALL HAVING count(DISTINCT k) > {MOST}),
x AS (SELECT k, sum(len(regexp_extract_all(line, '{WORD}'))) AS removed FROM l JOIN f USING (host, norm) GROUP BY k),
o AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, (len(words) - coalesce(removed, 0))::BIGINT AS words_left
      FROM w LEFT JOIN r USING (k) LEFT JOIN x USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left >= {WORDS_LEFT} AND words_left >= {SHARE_LEFT} * n_words AS kept, words_left FROM b
"""
