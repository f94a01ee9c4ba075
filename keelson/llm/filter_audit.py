"""How document filters interact: what each removes in every order of application, and its Shapley share.

One pass over the texts decides the filters that look at a text alone and reduces each row to a mask of
failed conditions, a length and hashes of three blocks. Duplicates are then found by partition refinement:
rows are split by their length in code points, then by one block's hash after another, and classes of one
row are dropped on the way. The full texts of what survives are compared with that of the class's smallest
id; rows that differ from it (their hashes collide) are compared with each other. Every order's figures
are sums over the counts of masks, of which there are at most 128 to a part, so rows are never expanded.

Edge cases: a null text is an empty one, a null source an empty string; a row without a doc_id is not a
duplicate and makes none; rows that share an id are told apart by their texts, and equal ones among them
fail only beside a smaller id; of several labels to an id, any that is 1 counts, and labels of other ids
and null ones don't; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, documents, kept, lean

FILTERS = "ABCDE"
#: Bits of a mask: a filter's by its place, and a document's labels.
DUPLICATE, GOOD, TOXIC = 16, 32, 64
#: Code points at which the first and the second block end.
BLOCKS = (256, 4096)
KEYS = ["length", "block1", "block2", "block3"]
#: Numbers that classes of duplicates are reduced to, to leave out texts of no class before texts are shuffled.
SIEVE = 1 << 20
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes are flagged between consecutive offsets."""
    total = np.add.reduceat(np.r_[flags, False].view(np.uint8), offsets[:-1], dtype=np.int64) if len(offsets) > 1 else np.zeros(0, int)
    return np.where(np.diff(offsets) > 0, total, 0)


PUNCTUATION = np.isin(np.arange(256), list(b"#$%&*|"))


def failures(column: pa.Array) -> np.ndarray:
    """The bits of the filters A to D for each text."""
    column = column.cast(pa.large_string())
    found = column_bytes(column)
    offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(int)
    data = np.frombuffer(b"".join(found), np.uint8)
    upper, marks = per_text((data >= 65) & (data <= 90), offsets), per_text(PUNCTUATION[data], offsets)
    words = np.zeros((2, len(found)), int)
    for i, text in enumerate(found):
        split = text.split()  # at the six white characters of ASCII, and no others
        words[:, i] = len(split), len(set(split))
    n, distinct = words
    fails = [n < 50, 100 * distinct < 65 * n, 100 * upper > 5 * pc.utf8_length(column).to_numpy(), marks > 0]
    return sum(f.astype(int) << i for i, f in enumerate(fails))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part and text, with the length in code points and the hashes of three blocks."""
    text = F.coalesce("text", F.lit(""))
    first, second = BLOCKS
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    blocks = [F.substring("text", 1, first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, 2**31 - 1 - second)]
    return rows.select("*", F.length("text").cast("long").alias("length"), *(F.xxhash64(b).alias(f"block{i + 1}") for i, b in enumerate(blocks)))


def masked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows without their texts but with ``mask``: the filters that a text alone fails, and its labels."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                mask = pa.array(failures(part.column("text"))).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), mask], names=[*others, "mask"])

    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((is_one("quality") * GOOD + is_one("toxic") * TOXIC).alias("marks"))
    return rows.select(*others, "text").mapInArrow(lean(run), schema).join(marks, "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("marks", F.lit(0))).drop("marks")


def refined(rows: DataFrame) -> DataFrame:
    """The rows whose length and blocks all equal those of another row: split key by key, classes of one row dropped each time."""
    rows = rows.filter("doc_id IS NOT NULL")
    for n in range(1, len(KEYS) + 1):
        # kept, so that the join reads two plain shuffles, which adaptive execution can split where a class is large
        classes = kept(rows.groupBy(*KEYS[:n]).agg(F.count("*").alias("n")).filter("n > 1"))
        rows = kept(rows.join(classes, KEYS[:n], "left_semi"))
    return rows


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and n: how many of a part's documents fail what ``mask`` says."""
    texts = keyed(docs)
    rows = kept(masked(texts, labels))
    alike = refined(rows)
    classes = alike.groupBy(*KEYS).agg(F.min("doc_id").alias("low"))
    # most texts are like no other: they stay where they are, sieved by at most SIEVE numbers, which is what is broadcast
    number = F.pmod(F.xxhash64(*KEYS), F.lit(SIEVE)).cast("int")
    sieve = classes.select(number.alias("number")).distinct()
    texts = texts.filter("doc_id IS NOT NULL").withColumn("number", number).join(F.broadcast(sieve), "number", "left_semi").drop("number")
    named = classes.select(*KEYS, "low", F.col("low").alias("doc_id"))  # the id is a key too, so a large class is no large partition
    firsts = kept(texts.join(named, [*KEYS, "doc_id"]).select(*KEYS, "low", F.col("text").alias("first")).dropDuplicates(KEYS))
    other = kept(texts.join(firsts, KEYS).filter(F.col("text") != F.col("first")).drop("first"))

    def move(found: DataFrame, old, new) -> DataFrame:
        """Takes the rows from one mask to another."""
        moves = F.explode(F.array(F.struct(old.alias("mask"), F.lit(-1).alias("n")), F.struct(new.alias("mask"), F.lit(1).alias("n"))))
        return found.select("part", moves.alias("move")).select("part", "move.mask", "move.n")

    def judged(low: str):
        return F.col("mask") + F.when(F.col("doc_id") > F.col(low), DUPLICATE).otherwise(0)

    parts = [rows.select("part", "mask", F.lit(1).alias("n")), move(alike.join(classes, KEYS).filter("doc_id > low"), F.col("mask"), judged("low"))]
    if other.count():  # a collision: whom the class's smallest id doesn't equal is judged beside its own equals
        own = other.join(other.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("own")), [*KEYS, "text"])
        parts.append(move(masked(own, labels), judged("low"), judged("own")))
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    return total.groupBy("part", "mask").agg(F.sum("n").alias("n")).filter("n > 0")


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def weights() -> np.ndarray:
    """For every order, step and figure, what a document of each mask counts."""
    masks = np.arange(128)
    failed = np.array([masks >> i & 1 for i in range(len(FILTERS))], bool)
    number = failed.sum(0)
    out = np.zeros((len(ORDERS), len(FILTERS), len(COUNTS), 128), int)
    for o, order in enumerate(ORDERS):
        gone = np.zeros(128, bool)
        for s, name in enumerate(order):
            own = failed[FILTERS.index(name)]
            removed = own & ~gone
            shapley = np.where(own, len(ORDERS) // np.maximum(number, 1), 0)  # the first of its failed filters in that many orders
            redundant, gone = own & gone, gone | own
            out[o, s] = ~gone, removed, redundant, own & (number == 1), removed & (masks & GOOD > 0), removed & (masks & TOXIC > 0), shapley
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of filters and step."""
    by_part = counted(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("counts"))  # 128 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights().reshape(-1, 128)
        orders = np.repeat(ORDERS, len(FILTERS))
        steps = np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                held = np.zeros(128, int)
                for x in counts:
                    held[x["mask"]] = x["n"]
                figures = (table @ held).reshape(len(steps), len(COUNTS)).T
                columns = [pa.array([part] * len(steps), pa.string()), pa.array(orders.tolist()), pa.array(steps).cast(pa.int32()), *map(pa.array, figures)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(lean(run), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, [w FOR w IN string_split_regex(text, '[\x20\x09-\x0D]+') IF w <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM texts),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails
    FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, good, toxic, fails, count(*) AS n, len([f FOR f IN fails IF f]) AS failed FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, [instr('ABCDE', substr(filter_order, CAST(i AS INTEGER), 1)) FOR i IN range(1, 6)] AS places FROM orders, range(1, 6) r(step)),
each AS (
    SELECT part, filter_order, step, n, good, toxic, failed, fails[places[step]] AS own,
        len([i FOR i IN places[1:step - 1] IF fails[i]]) > 0 AS gone
    FROM steps, counts)
SELECT part, filter_order, step,
    CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN own THEN n * 120 // failed ELSE 0 END) AS BIGINT) AS shapley
FROM each GROUP BY part, filter_order, step
"""
