"""Toxic passages by maximum-scoring segment search.

Words score by their log-odds between toxic and clean labelled documents, under a Dirichlet prior that is
proportional to how many of all documents have them. A word's features are the word and its prefixes, in
a hashed table; its score is the best feature's lower confidence bound, so that rare words score below
zero. A linear-time scan (Ruzzo and Tompa) finds every maximal-scoring segment of a document. Scores of
segments are calibrated by the extreme-value law of such maxima over clean documents (Karlin and
Altschul), a document's significant segments are added up, and a logistic curve fitted on the labelled
documents turns that into a probability.

The prior counts features over all documents, held-out ones too; it sees no label of theirs.

Edge cases: a null or empty text has no segment and gets the score of such a document; documents whose
labels disagree take the majority, ties toxic; labels of unknown documents and null labels are left out;
equal labelled texts count once; without labels of both kinds every score is 0.5; a null doc_id counts as
not held out; repeated rows are repeated; whole long texts are scanned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, column_bytes, documents, lean, map_rows, texts
from .licenses import words_of

#: Slots of the hashed feature table, as a power of two.
BITS = 20
#: Bytes of the prefixes that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: The most labelled rows that the word scores are learned from; more are sampled by the hash of their id.
LABELLED = 2_000_000
#: The prior: documents for each feature, and a share of the toxic features' number that is dealt out as all documents have them.
PRIOR, PRIOR_SHARE = 0.5, 0.01
#: The normal quantile of the lower bound.
QUANTILE = 2.33
#: Scores are held between these.
LOW, HIGH = -0.4, 8.0
#: Distinct words that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 1_000_000
#: Slots to a row when tables are added up.
SLAB = 1 << 14


def features(word: bytes) -> list[int]:
    mask = (1 << BITS) - 1
    return [zlib.crc32(word) & mask, *(zlib.crc32(word[:k], k) & mask for k in PREFIXES if len(word) >= k)]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the labelled training documents, one for each text; ``bound`` of them at most."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    ids = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("its_text")).join(known, "doc_id")
    rows = ids.groupBy("its_text").agg(F.min(F.struct("doc_id", "label")).alias("first")).select("first.*")
    if rows.count() > bound:
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = rows.toPandas().sort_values("doc_id")
    return found["doc_id"].to_numpy(np.int64), found["label"].to_numpy(np.int8)


def labels_of(ids: pa.Array, known: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The training label of each id; -1 without one."""
    if not len(known):
        return np.full(len(ids), -1)
    wanted = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, label[at], -1)


def labelled(docs: DataFrame, known: np.ndarray, label: np.ndarray) -> DataFrame:
    """(text, y) of the training documents; their ids, ``LABELLED`` at most, are broadcast."""
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": known, "y": label.astype(np.int64)}), "doc_id long, y long")
    return texts(docs).join(F.broadcast(ids), "doc_id").select("text", "y")


def feature_counts(docs: DataFrame, known: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Documents with each feature: all, clean training and toxic training ones. The last column has their totals.

    A task adds its documents up in a table of fixed size; tables are added slab by slab.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((known, label))
    slots = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((3, slots), np.int64)
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            for text, y in zip(column_bytes(batch.column("text")), labels_of(batch.column("doc_id"), *held.value).tolist()):
                words = set(words_of(text))
                for w in words.difference(seen):
                    seen[w] = np.array(features(w), np.int32).tobytes()
                found = np.unique(np.frombuffer(b"".join(map(seen.__getitem__, words)), np.int32))
                table[0, found] += 1
                if y >= 0:
                    table[1 + y, found] += 1
        for k in range(0, slots, SLAB):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([table[:, k : k + SLAB].astype("<u4").tobytes()])], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v")):
                part = np.frombuffer(v.as_buffer(), "<u4").astype(np.int64)
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()])], names=["k", "v"])
                    at, total = k, part
                else:
                    total = total + part
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()])], names=["k", "v"])

    parts = texts(docs).mapInArrow(lean(count), "k long, v binary")
    added = parts.repartition(slots // SLAB, "k").sortWithinPartitions("k").mapInArrow(lean(add), "k long, v binary")
    table = np.zeros((3, slots), np.int64)
    for k, v in added.collect():
        table[:, k : k + SLAB] = np.frombuffer(v, np.int64).reshape(3, -1)
    held.unpersist()
    return table


def log_odds(table: np.ndarray) -> np.ndarray:
    """Lower confidence bounds of the features' log-odds, toxic against clean."""
    total = table.sum(axis=1)
    prior = PRIOR + PRIOR_SHARE * total[2] * table[0] / max(total[0], 1)
    clean, toxic = table[1] + prior, table[2] + prior
    mass = prior.sum()
    ratio = np.log(toxic / (total[2] + mass - toxic)) - np.log(clean / (total[1] + mass - clean))
    return np.clip(ratio - QUANTILE * np.sqrt(1 / toxic + 1 / clean), LOW, HIGH).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def word_score(self, word: bytes) -> float:
        return float(self.weights[features(word)].max())


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal-scoring segment, by one pass over the positive scores (Ruzzo and Tompa).

    Each segment that is held knows the nearest one before it whose left total is lower, so a search steps
    over those that a later one has passed already, and the scan takes linear time whatever the scores are.
    """
    total = np.r_[0.0, np.cumsum(score, dtype=np.float64)]
    up = np.flatnonzero(score > 0)
    held: list[tuple[int, int, float, float, int]] = []
    for start, left, right in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        end, j = start + 1, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right, j))
                break
            start, _, left, _, lower = held[j]
            del held[j:]
            j = lower
    return [(s, e, r - l) for s, e, l, r, _ in held]


class Scorer:
    """Scores words and documents; remembers the words."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}

    def words(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        try:
            return np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            for w in set(words).difference(self.seen):
                self.seen[w] = self.model.word_score(w)
            return np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        """Significant segments with what they have beyond the score that chance reaches in this text, and the words."""
        score = self.words(text)
        chance = math.log(max(self.model.scale * max(len(score), 1), 1e-300))
        found = [(s, e, self.model.rate * v - chance) for s, e, v in maximal_segments(score)]
        return [x for x in found if x[2] > 0], len(score)

    def strength(self, text: bytes) -> tuple[float, int, int]:
        found, n = self.passages(text)
        return math.log1p(sum(x[2] for x in found)), len(found), n

    def probability(self, strength: float) -> float:
        a, b = self.model.curve
        return 1 / (1 + math.exp(-(a + b * strength)))


def extreme_value_law(docs: DataFrame, weights: np.ndarray, known: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """rate and scale with P(maximum >= x over n words) = 1 - exp(-scale * n * exp(-rate * x)) in clean documents.

    The rate makes the mean of exp(rate * score) one over the clean words, plus one word of the highest
    score that is never seen otherwise; the scale follows from the documents' maxima.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    bins = np.linspace(LOW, HIGH, 421)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(held.value))
        count, maxima = np.zeros(len(bins)), []
        for batch in batches:
            for text in column_bytes(batch.column("text")):
                score = scorer.words(text)
                count += np.bincount(np.searchsorted(bins, score.astype(np.float32) - 1e-6), minlength=len(bins))[: len(bins)]
                if len(score):
                    maxima.append((max((x[2] for x in maximal_segments(score)), default=0.0), math.log(len(score))))
        rows = [(i, float(c)) for i, c in enumerate(count) if c] + [(-1, float(len(maxima))), (-2, float(sum(m for m, _ in maxima))), (-3, float(sum(n for _, n in maxima)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["k", "v"])

    sums = dict(labelled(docs, known, label).filter("y = 0").mapInArrow(lean(run), "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    held.unpersist()
    count = np.array([sums.get(i, 0.0) for i in range(len(bins))])
    count[-1] += 1
    share = count / count.sum()
    low, high = 1e-3, 50.0
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if float(share @ np.exp(np.minimum(rate * bins, 700))) < 1 else (low, rate)
    n = max(sums.get(-1, 0.0), 1.0)
    scale = math.exp(min(0.0, rate * sums.get(-2, 0.0) / n - sums.get(-3, 0.0) / n - 0.5772))
    return rate, scale


def probability_curve(docs: DataFrame, model: Model, known: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the strength of the labelled documents, fitted to their histogram."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    width = 0.05

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        count: dict[int, int] = {}
        for batch in batches:
            for text, y in zip(column_bytes(batch.column("text")), batch.column("y").to_pylist()):
                k = 2 * min(int(scorer.strength(text)[0] / width), 1000) + y
                count[k] = count.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["k", "v"])

    sums = labelled(docs, known, label).mapInArrow(lean(run), "k long, v long").groupBy("k").agg(F.sum("v")).collect()
    held.unpersist()
    k, n = np.array([r[0] for r in sums]), np.array([r[1] for r in sums], float)
    y, x = k % 2, k // 2 * width
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    if not pos or not neg:
        return 0.0, 0.0
    want = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    at = np.stack([np.ones(len(x)), x])
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-theta @ at))
        grad = at @ (n * (want - p)) - 1e-3 * theta
        theta = theta + np.linalg.solve((at * (n * p * (1 - p))) @ at.T + 1e-3 * np.eye(2), grad)
        if np.abs(grad).max() < 1e-6:
            break
    return float(theta[0]), float(max(theta[1], 0.0))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    known, y = training_rows(docs, labels, label)
    model = Model(log_odds(feature_counts(docs, known, y)))
    if len(set(y.tolist())) == 2:
        model.rate, model.scale = extreme_value_law(docs, model.weights, known, y)
        model.curve = probability_curve(docs, model, known, y)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and the first word of the first passage."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch, scorer: Scorer) -> dict:
        rows = [scorer.strength(t) for t in column_bytes(batch.column("text"))]
        score = [scorer.probability(r[0]) for r in rows]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": [int(s >= threshold) for s in score], "n_passages": [r[1] for r in rows]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, step, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int", lambda: Scorer(held.value))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, rows and columns as they are.

    A null or empty text has no toxic passage and stays; a null doc_id or source changes nothing; repeated
    rows go or stay together; without labels of both kinds every document stays; an empty table gives none;
    columns beside those of documents go.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            clean = [scorer.probability(scorer.strength((t or "").encode())[0]) < 0.7 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
