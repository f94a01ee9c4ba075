"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A word is coded in bits. First, whether it has followed the two words before it; if not, whether it has
followed the word before it; a word that has is then told by its share of what followed. Any other word
has the bits of its path in a Huffman tree over the most frequent training words, an end mark and an
escape, and what follows an escape costs the word's share of the words beyond the tree. Each bit has
several predictors: adaptive counts of hashed contexts (how often the words before were seen, what the
last words' bits were, the document's bits so far; the tree's node over all words and in this document).
Their logits are added up with weights that a gate picks by context; weights and counts learn online over
the training documents, and an adaptive map from mixed to observed probability refines the mix.

How often words, pairs and triples of words occur in the training documents is counted, whatever
their number: documents are packed into groups, a group asks each slab of the hash space for the counts of
its own words, pairs and triples, and the slab answers it. So no table is collected or broadcast but the
tree (``HEAD`` words at most) and the predictors. A document's own occurrences never count for itself but
as it goes on: a training document is scored by the other ones and by what it has shown before.

Groups follow from the documents alone, and what they learn is added up in whole numbers, so that scores
don't depend on the table's layout. Words are told by 64 bits, pairs and triples by a slab and 32 bits in
it, where a slab has some millions: one in a thousand is taken for another.

Edge cases: a null or empty text is just the end mark; words never seen count half an occurrence, as in
the base; without training documents the scores are those of empty counts; rows that agree in doc_id and
text are scored alike and each reported; a null doc_id counts as training; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, column_bytes, documents, kept, lean, mix64, parts_for, release, runs

#: Words in the tree; its nodes have to fit into 16 bits.
HEAD = 65_000
#: Documents to a group, and the bytes at which a group is parted.
GROUP, GROUP_BYTES = 1024, 4 << 20
#: Words, pairs and triples to a slab of the hash space.
SLAB = 3_000_000
#: Depths and confidence levels of the tree's bits, bins of the refinement, and classes of counts.
DEPTHS, LEVELS, BINS, CLASSES = 14, 4, 33, 8
#: Kinds of bits: the triple was seen, the pair was seen.
KINDS = 2
#: Words that are mixed together before the weights move on, and words of several documents that are worked on at once.
BLOCK, CHUNK = 16_384, 40_000
#: Stands for the end of a text; no word has a space.
END = b" "
#: What tasks learn is added up in units of 2^-24.
UNIT = 1 << 24
#: Buckets of counts to a doubling, from which the tree's words are chosen.
STEPS = 16


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


@dataclass
class Tree:
    """Huffman paths of the symbols, flat: nodes and bits of symbol s lie at start[s]:start[s + 1]."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    first: np.ndarray  # logit of each node's bit by the words' counts
    share: np.ndarray  # its probability
    nodes: int


def tree_of(counts: list[int]) -> Tree:
    heap = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n = len(counts)
    parent, side, weight = {}, {}, dict(enumerate(counts))
    made = n
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], side[x], parent[y], side[y] = made, 0, made, 1
        weight[made] = a + b
        heapq.heappush(heap, (a + b, made, made))
        made += 1
    paths = []
    for s in range(n):
        path, x = [], s
        while x in parent:
            path.append((parent[x] - n, side[x]))
            x = parent[x]
        paths.append(path[::-1])
    ones = np.zeros(max(made - n, 1))
    both = np.ones(max(made - n, 1))
    for x, p in parent.items():
        both[p - n] = weight[p]
        if side[x]:
            ones[p - n] = weight[x]
    flat = [x for p in paths for x in p]
    size = np.array([len(p) for p in paths])
    first = stretch(np.clip((ones + 0.5) / (both + 1), 1e-6, 1 - 1e-6)).astype(np.float32)
    depth = np.concatenate([np.arange(k) for k in size] or [np.zeros(0)])
    return Tree(np.r_[0, np.cumsum(size)], np.array([x[0] for x in flat], np.uint16), np.array([x[1] for x in flat], np.int64), np.minimum(depth, DEPTHS - 1).astype(np.int64), first, squash(first), max(made - n, 1))


def earlier(tree: Tree, symbols: np.ndarray, doc: np.ndarray, first: np.ndarray, events: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each event's node came before in its document, and with bit 1. The events of a word lie from ``first`` on.

    Goes down the tree, with the words of a node and document side by side in their order. Words that are
    alone there have nothing before them, and those of a leaf are done.
    """
    n, n1 = np.zeros(events, np.int32), np.zeros(events, np.int32)
    begin, length = tree.start[symbols], tree.start[symbols + 1] - tree.start[symbols]
    word, level = np.arange(len(symbols)), 0
    start, end = runs(doc)
    size = end - start
    while True:
        more = size > 1
        more[more] = length[word[(np.cumsum(size) - size)[more]]] > level
        word, size = word[np.repeat(more, size)], size[more]
        if not len(word):
            return n, n1
        start = np.cumsum(size) - size
        bit = tree.bit[begin[word] + level]
        before = np.cumsum(bit) - bit
        before -= np.repeat(before[start], size)
        ones = np.add.reduceat(bit, start)
        place = np.arange(len(word))
        at = first[word] + level
        n[at], n1[at] = place - np.repeat(start, size), before
        below = np.empty_like(word)
        below[np.where(bit, np.repeat(start + size - ones, size) + before, place - before)] = word
        word, size = below, np.stack([size - ones, ones], 1).ravel()
        level += 1


#: Confidence of a node by how often it came before: never, to 3, to 20, more.
LEVEL_OF = np.repeat(np.arange(LEVELS), (1, 3, 17, 1))


#: Classes of counts: 0 for none, then 1, 2, to 4, to 8, to 32, to 256, more.
CLASS_OF = np.repeat(np.arange(CLASSES), (1, 1, 1, 2, 4, 24, 224, 1))


def class_of(n: np.ndarray) -> np.ndarray:
    return CLASS_OF[np.minimum(n, len(CLASS_OF) - 1)]


@dataclass
class Mixer:
    """Predictors over ``contexts`` hashed contexts in all, weights by gate, and the refinement by mixed logit.

    ``ones`` and ``seen`` count the contexts' bits; ``hits`` and ``tries`` those of the refinement.
    """

    inputs: int
    gates: int
    contexts: int
    cells: int
    start: float
    weights: np.ndarray = field(init=False)
    events: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = np.full((self.inputs, self.gates), self.start, np.float32)
        self.events = np.zeros(self.gates)
        self.ones, self.seen = np.zeros(self.contexts), np.zeros(self.contexts)
        self.hits, self.tries = np.zeros(self.cells * BINS), np.zeros(self.cells * BINS)

    def logits(self, contexts: list[np.ndarray]) -> list[np.ndarray]:
        table = np.log((self.ones + 0.4) / (self.seen - self.ones + 0.4)).astype(np.float32)
        return [table[c] for c in contexts]

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        total = self.weights[0][gate] * x[0]
        for i in range(1, self.inputs):
            total += self.weights[i][gate] * x[i]
        return np.clip(total, -14, 14)

    def bins(self, logit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return cell * BINS + np.clip(np.round((logit + 8) * ((BINS - 1) / 16)), 0, BINS - 1).astype(np.int64)

    def cost(self, logit: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the refined probability of each bit."""
        middle = np.tile(squash(np.linspace(-8, 8, BINS)), self.cells)
        refined = ((self.hits + 30 * middle) / (self.tries + 30)).astype(np.float32)
        p = np.clip((squash(logit) + refined[self.bins(logit, cell)]) * np.float32(0.5), 1e-6, 1 - 1e-6)
        return np.log10(np.where(bit, p, 1 - p))

    def learn(self, x: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, bit: np.ndarray, contexts: list[np.ndarray]) -> None:
        """One step along the mean gradient of each gate's events; then the counts go up."""
        logit = self.mix(x, gate)
        at = self.bins(logit, cell)
        self.hits += np.bincount(at, bit, len(self.hits))
        self.tries += np.bincount(at, minlength=len(self.tries))
        error = bit - squash(logit)
        count = np.bincount(gate, minlength=self.gates)
        for i in range(self.inputs):
            self.weights[i] += (np.bincount(gate, error * x[i], self.gates) / (count + 60)).astype(np.float32)
        self.events += count
        for c in contexts:
            self.ones += np.bincount(c, bit, self.contexts)
            self.seen += np.bincount(c, minlength=self.contexts)

    def state(self) -> np.ndarray:
        """What was learned, as whole numbers that can be added up in any order."""
        parts = [self.weights * self.events, self.events, self.ones, self.seen, self.hits, self.tries]
        return np.round(np.concatenate([p.ravel() for p in parts]) * UNIT).astype(np.int64)

    def load(self, total: np.ndarray) -> None:
        size = [self.inputs * self.gates, self.gates, self.contexts, self.contexts, self.cells * BINS, self.cells * BINS]
        w, self.events, self.ones, self.seen, self.hits, self.tries = np.split(total / UNIT, np.cumsum(size)[:-1])
        self.weights = np.where(self.events > 0, w.reshape(self.inputs, -1) / np.maximum(self.events, 1), self.start).astype(np.float32)


#: Contexts of a kind's three predictors: count and the last three words' bits, both counts, count and the document so far.
PART = (CLASSES * 27, CLASSES * CLASSES, CLASSES * 16)


def mixers() -> tuple[Mixer, Mixer]:
    """Of the bits that say what was seen, and of the tree's."""
    return Mixer(3, KINDS * CLASSES * 3, KINDS * sum(PART), KINDS * CLASSES, 0.4), Mixer(2, DEPTHS * LEVELS, 1, DEPTHS, 0.5)


@dataclass
class Model:
    total: int
    distinct: int
    documents: int
    hashes: np.ndarray  # of the tree's words, ascending
    symbol: np.ndarray
    counts: np.ndarray  # by symbol
    tree: Tree
    flags: Mixer
    bits: Mixer

    @property
    def beyond(self) -> float:
        """What all words beyond the tree count, an unknown one included."""
        return max(self.total - int(self.counts.sum()), 0) + 0.5 * (self.distinct - len(self.counts) + 1)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words by their hashes; the last one is the escape."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.symbol[at], len(self.counts))


#: XXH64's primes.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def short_hashes(text: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the strings of ``size`` bytes, fewer than 32, that start at these places; eight bytes have to follow the last."""
    eight, four = (np.ndarray(len(text) - 7, kind, text, strides=(1,)) for kind in ("<u8", "<u4"))
    h = np.full(len(start), P5 + np.uint64(size))
    at = start
    for _ in range(size // 8):
        h ^= turned(eight[at] * P2, 31) * P1
        h = turned(h, 27) * P1 + P4
        at = at + 8
    if size & 4:
        h ^= four[at].astype(np.uint64) * P1
        h = turned(h, 23) * P2 + P3
        at = at + 4
    for i in range(size & 3):
        h ^= text[at + i].astype(np.uint64) * P5
        h = turned(h, 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


class Reader:
    """Hashes of the words of texts, taken from all texts at once and by the words' length."""

    def __init__(self) -> None:
        self.end = xxhash.xxh64_intdigest(END)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """XXH64 of each text's words and of its end, and how many these are in each text."""
        whole = b" ".join([*texts, b" " * 8]).lower()
        text = np.frombuffer(whole, np.uint8)
        inside = (text != 32) & (text - np.uint8(9) > 4)
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        start, size = edge[::2], edge[1::2] - edge[::2]
        words = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])), prepend=0) + 1 if texts else np.zeros(0, np.int64)
        found = np.empty(len(start), np.uint64)
        order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
        for a, b in zip(*runs(np.minimum(size[order], 32))):
            to = order[a:b]
            if size[to[0]] < 32:
                found[to] = short_hashes(text, start[to], int(size[to[0]]))
            else:
                found[to] = np.fromiter((xxhash.xxh64_intdigest(whole[i : i + k]) for i, k in zip(start[to].tolist(), size[to].tolist())), np.uint64, b - a)
        out = np.full(len(start) + len(texts), self.end, np.uint64)
        its = np.ones(len(out), bool)
        its[np.cumsum(words) - 1] = False
        out[its] = found
        return out, words


class Grams:
    """A group's words and the hashes of words, pairs and triples, in order and sorted."""

    def __init__(self, texts: list[bytes], train: np.ndarray, reader: Reader) -> None:
        word, self.size = reader.words(texts)
        self.start = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.train = train[self.doc]
        before = np.r_[np.uint64(0), word[:-1]]
        before[self.start] = 1
        pair = mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)
        context = np.r_[np.uint64(0), pair[:-1]]
        context[self.start] = 2
        triple = mix64(context * np.uint64(0xD6E8FEB86659FD93) + word)
        self.hashes = (word, pair, triple)

    def sorted(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stable order that sorts the hashes, where each new one starts, and the distinct ones.

        Sorts the leading bits with the place behind them, as plain numbers, which takes a tenth of the
        time; where other hashes agree in those bits and come out of order, it sorts again by all bits.
        """
        h = self.hashes[order]
        bits = np.uint64(len(h).bit_length())
        key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
        key.sort()
        to = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        found = h[to]
        if (found[1:] < found[:-1]).any():
            to = np.argsort(h, kind="stable")
            found = h[to]
        start, _ = runs(found)
        return to, start, found[start]

    def counts(self, order: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the distinct hashes' totals: each word's total, and what it was seen in other documents and before in its own."""
        to, start, _ = self.sorted(order)
        n = len(to)
        doc = self.doc[to]
        new = np.zeros(n, bool)
        new[start] = True
        new[1:] |= doc[1:] != doc[:-1]
        own = np.flatnonzero(new)
        size = np.diff(np.r_[own, n])
        every = np.repeat(total, np.diff(np.r_[start, n]))
        seen = every - np.where(self.train[to], np.repeat(size, size), 0) + np.arange(n) - np.repeat(own, size)
        out = np.empty((2, n), np.int64)
        out[0][to], out[1][to] = every, np.maximum(seen, 0)
        return out[0], out[1]


def slab_of(h: np.ndarray, slabs: int) -> tuple[np.ndarray, np.ndarray]:
    """The slab of each hash, ascending with it, and 32 bits that tell the hashes of a slab apart, ascending too."""
    high, low, n = h >> np.uint64(32), h & np.uint64(2**32 - 1), np.uint64(slabs)
    with np.errstate(over="ignore"):
        return ((high * n + (low * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64), (h * n >> np.uint64(32)).astype(np.uint32)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), codec="zstd", asbytes=True)


def loosened(raw: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def differences(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def events_of(grams: Grams, seen: list[np.ndarray], documents: int) -> tuple[np.ndarray, ...]:
    """Of the bits of both kinds: word, kind, contexts, gate, cell and bit; then of each word what it costs beside its bits, and whether the tree codes it."""
    n0, n1, n2 = seen
    shift = lambda x, first: np.where(at_start, first, np.r_[0, x[:-1]])
    at_start = np.zeros(len(n0), bool)
    at_start[grams.start] = True
    all1 = shift(n0, documents - grams.train.astype(np.int64))
    all2 = shift(n1, 0)
    n1, n2 = np.minimum(n1, all1), np.minimum(n2, all2)
    outcome = np.where(n2 > 0, 2, np.where(n1 > 0, 1, 0))
    last = [shift(outcome, 0)]
    for _ in range(2):
        last.append(shift(last[-1], 0))
    history = last[0] * 9 + last[1] * 3 + last[2]
    place = np.arange(len(n0)) - grams.start[grams.doc]
    c1, c2 = class_of(all1), class_of(all2)
    rows = []
    for kind, (n, every, c, other) in enumerate(((n2, all2, c2, c1), (n1, all1, c1, c2))):
        hit = n > 0
        before = np.cumsum(hit) - hit
        before -= before[grams.start][grams.doc]
        rate = (before * 15) // np.maximum(place, 1)
        coded = every > 0 if kind == 0 else (every > 0) & (outcome < 2)
        t = np.flatnonzero(coded)
        base = kind * sum(PART)
        contexts = [base + c[t] * 27 + history[t], base + PART[0] + c[t] * CLASSES + other[t], base + PART[0] + PART[1] + c[t] * 16 + rate[t]]
        rows.append((t, contexts, (kind * CLASSES + c[t]) * 3 + last[0][t], kind * CLASSES + c[t], hit[t]))
    share = np.zeros(len(n0))
    two, one = outcome == 2, outcome == 1
    share[two] = np.log10(n2[two] / all2[two])
    share[one] = np.log10(n1[one] / all1[one])
    return rows, share, outcome == 0


def tree_events(model: Model, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the bits of the words' paths: word, inputs, gate, depth and bit."""
    tree = model.tree
    size = tree.start[symbols + 1] - tree.start[symbols]
    word = np.repeat(np.arange(len(symbols)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(word)) + np.repeat(tree.start[symbols] - first, size)
    node, bit, depth = tree.node[at], tree.bit[at], tree.depth[at]
    n, n1 = earlier(tree, symbols, doc, first, len(word))
    share = tree.share[node] * np.float32(1.5)
    ones = n1.astype(np.float32) + share
    own = np.clip(np.log(ones / (n.astype(np.float32) + np.float32(1.5) - ones)), -11.5, 11.5)
    return word, [tree.first[node], own], depth * LEVELS + LEVEL_OF[np.minimum(n, len(LEVEL_OF) - 1)], depth, bit


def chunks_of(doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words of whole documents, about a chunk each."""
    if not len(doc):
        return []
    ends = np.r_[np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)]
    cut = ends[np.r_[np.flatnonzero(np.diff(ends // CHUNK)), len(ends) - 1]]
    return list(zip(np.r_[0, cut[:-1]].tolist(), cut.tolist()))


def group_scores(model: Model, grams: Grams, totals: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of each document: words, known words, and log10 probabilities of base and model."""
    n = len(grams.size)
    every, seen = zip(*(grams.counts(k, totals[k]) for k in range(3)))
    rows, cost, novel = events_of(grams, list(seen), model.documents)
    for t, contexts, gate, cell, bit in rows:
        cost[t] += model.flags.cost(model.flags.mix(model.flags.logits(contexts), gate), cell, bit)
    new = np.flatnonzero(novel)
    symbols = model.symbols(grams.hashes[0][new])
    escaped = symbols == len(model.counts)
    out = new[escaped]
    cost[out] += np.log10((np.minimum(seen[0], every[0])[out] + 0.5) / model.beyond)
    for a, b in chunks_of(grams.doc[new]):
        word, x, gate, depth, bit = tree_events(model, symbols[a:b], grams.doc[new[a:b]])
        cost[new[a:b]] += np.bincount(word, model.bits.cost(model.bits.mix(x, gate), depth, bit), b - a)
    return base_columns(grams, every[0], model.total, model.distinct) | {"score": np.bincount(grams.doc, cost, n)}


def base_columns(grams: Grams, every: np.ndarray, total: int, distinct: int) -> dict[str, np.ndarray]:
    """Of each document: words, known words and the base's log10 probability, from each word's count."""
    n = len(grams.size)
    base = np.log10((every + 0.5) / (total + 0.5 * (distinct + 1)))
    return {"n_tokens": grams.size, "n_known": np.bincount(grams.doc, every > 0, n).astype(np.int64), "base_score": np.bincount(grams.doc, base, n)}


def group_learns(model: Model, grams: Grams, totals: list[np.ndarray]) -> np.ndarray:
    """What the mixers learn online over a group's words, from the start."""
    flags, bits = mixers()
    seen = [grams.counts(k, totals[k])[1] for k in range(3)]
    rows, _, novel = events_of(grams, seen, model.documents)
    for a in range(0, len(novel), BLOCK):
        for t, contexts, gate, cell, bit in rows:
            i, j = np.searchsorted(t, (a, a + BLOCK))
            part = [c[i:j] for c in contexts]
            flags.learn(flags.logits(part), gate[i:j], cell[i:j], bit[i:j].astype(np.int64), part)
    new = np.flatnonzero(novel)
    symbols = model.symbols(grams.hashes[0][new])
    for a, b in chunks_of(grams.doc[new]):
        _, x, gate, depth, bit = tree_events(model, symbols[a:b], grams.doc[new[a:b]])
        bits.learn(x, gate, depth, bit, [])
    return np.concatenate([flags.state(), bits.state()])


def group_row(parts: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
    part = pa.Table.from_batches(parts).select(["doc_id", "held_out", "text"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(part)
    values = (name, parts[0].column("learns")[0].as_py(), part.num_rows - (pa.compute.sum(part["held_out"]).as_py() or 0), pa.compute.sum(pa.compute.binary_length(part["text"])).as_py(), sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["id", "learns", "n_train", "n_bytes", "docs"])


def packed_groups(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(id, learns, n_train, n_bytes, docs): documents in groups; ``docs`` is an Arrow stream.

    Training documents, which all teach the weights, are grouped and ordered by their hashes, so that what a
    group teaches follows from them alone; the others' groups, which change no result, are as the documents come.
    """
    text = F.coalesce("text", F.lit(""))
    its_fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    n = docs.count()
    rows = docs.select("doc_id", (its_fold == fold).alias("held_out"), (its_fold != fold).alias("learns"), text.alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        size, key, seq, task = 0, None, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            return group_row(held, f"-{key}.{seq}" if held[0].column("learns")[0].as_py() else f"{task}.{seq}")

        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            ends = runs(keys)[1]
            total = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy() + 64)
            at = 0
            while at < batch.num_rows:
                if keys[at] != key:
                    if held:
                        yield flush()
                    held, size, key, seq = [], 0, keys[at], 0
                end = int(ends[np.searchsorted(ends, at, side="right")])
                before = int(total[at - 1]) if at else 0
                to = min(end, at + 1 + int(np.searchsorted(total[at:end] - before, GROUP_BYTES - size)))
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - before
                at = to
                if size >= GROUP_BYTES:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    schema = "id string, learns boolean, n_train long, n_bytes long, docs binary"
    taught = rows.filter("learns").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    taught = taught.withColumn("bucket", F.pmod("h", F.lit(max(1, n // GROUP)))).repartition(parts_for(docs.sparkSession, n, 16 * GROUP), "bucket").sortWithinPartitions("bucket", "h", "doc_id")
    others = rows.filter("not learns").withColumn("bucket", F.lit(0).cast("long"))
    found = taught.select("doc_id", "held_out", "learns", "text", "bucket").mapInArrow(lean(pack), schema).union(others.mapInArrow(lean(pack), schema))
    return kept(found)


def grams_of(raw: pa.Scalar, reader: Reader) -> tuple[pa.Table, Grams]:
    table = pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks()
    return table, Grams(column_bytes(table["text"].combine_chunks()), ~table["held_out"].to_numpy(), reader)


#: Differences and bytes of what is asked (key of a slab, training occurrences) and answered, by order.
KEYS = (np.uint64, np.uint32, np.uint32)


def asked(groups: DataFrame, slabs: int, orders: int = 3) -> DataFrame:
    """(id, slab, ord, n, keys, counts): each group's distinct words, pairs and triples (as many ``orders``) by slab, with how often its training documents have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for name, raw in zip(batch.column("id").to_pylist(), batch.column("docs")):
                grams = grams_of(raw, reader)[1]
                for order in range(orders):
                    to, start, h = grams.sorted(order)
                    if not len(h):
                        continue
                    counts = np.add.reduceat(grams.train[to], start, dtype=np.uint32)
                    slab, low = slab_of(h, slabs)
                    keys = low if order else h
                    begin, end = runs(slab)
                    out = [(name, int(slab[a]), order, b - a, squeezed(differences(keys[a:b])), squeezed(counts[a:b])) for a, b in zip(begin.tolist(), end.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "slab", "ord", "n", "keys", "counts"])

    return groups.select("id", "docs").mapInArrow(lean(ask), "id string, slab long, ord long, n long, keys binary, counts binary")


ANSWER = "id string, slab long, ord long, n long, counts binary, total long, bins array<long>"


def answered(questions: DataFrame, parts: int) -> DataFrame:
    """(id, slab, ord, n, counts) of each question, and for each slab a row without id: its most frequent words and their counts, the sum of all, and how many have how many."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "both", 1):
            for s, e in zip(*runs(table["both"].to_numpy())):
                part = table.slice(s, e - s)
                order, sizes = part["ord"][0].as_py(), part["n"].to_pylist()
                keys = np.concatenate([np.cumsum(loosened(k.as_buffer(), n, KEYS[order]), dtype=KEYS[order]) for k, n in zip(part["keys"], sizes)])
                counts = np.concatenate([loosened(c.as_buffer(), n, np.uint32) for c, n in zip(part["counts"], sizes)])
                to = np.argsort(keys, kind="stable")
                start, end = runs(keys[to])
                total = np.add.reduceat(counts[to].astype(np.int64), start)
                each = np.empty(len(keys), np.int64)
                each[to] = np.repeat(total, end - start)
                if order:
                    each = np.minimum(each, 2**32 - 1).astype(np.uint32)
                out = [(i, slab, order, n, squeezed(x), None, None) for i, slab, n, x in zip(part["id"].to_pylist(), part["slab"].to_pylist(), sizes, np.split(each, np.cumsum(sizes)[:-1]))]
                if not order:
                    some = np.flatnonzero(total)
                    first = some[np.lexsort((keys[to][start][some], -total[some]))[:HEAD]]
                    bins = np.bincount((np.log2(total[some]) * STEPS).astype(int), minlength=1)
                    out.append((None, part["slab"][0].as_py(), 0, len(first), squeezed(np.r_[keys[to][start][first], total[first].astype(np.uint64)]), int(total.sum()), bins.tolist()))
                yield rows(out)

    keyed = questions.withColumn("both", F.col("slab") * 3 + F.col("ord"))
    return kept(keyed.repartition(parts, "both").sortWithinPartitions("both", "id").mapInArrow(lean(answer), ANSWER))


def tree_words(answers: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Occurrences and number of all training words; hashes and counts of the most frequent, ``HEAD`` at most, in whole buckets of counts."""
    own = answers.filter("id IS NULL")
    total = own.agg(F.sum("total")).first()[0] or 0
    bins = dict(own.select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n")).collect())
    number = np.array([bins.get(i, 0) for i in range(max(bins, default=-1) + 1)], np.int64)
    above = np.cumsum(number[::-1])[::-1]
    cut = int(np.argmax(above <= HEAD)) if (above <= HEAD).any() else len(number)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("counts")):
                h, c = loosened(raw.as_buffer(), 2 * n, np.uint64).reshape(2, n)
                some = (np.log2(c) * STEPS).astype(int) >= cut
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names=["h", "c"])

    found = own.select("n", "counts").mapInArrow(lean(choose), "h long, c long").toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    return int(total), int(number.sum()), h[order], c[order]


def with_answers(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """(docs, answers) of each group; ``answers`` in the order of its distinct words, pairs and triples."""
    own = answers.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "slab", "n", "counts"))).alias("answers"))
    return groups.join(own, "id").select("docs", "answers")


def totals_of(answers: pa.Scalar) -> list[np.ndarray]:
    rows = answers.values
    order, n, counts = rows.field("ord").to_numpy(), rows.field("n").to_pylist(), rows.field("counts")
    return [np.concatenate([loosened(counts[i].as_buffer(), n[i], np.uint32 if k else np.int64) for i in np.flatnonzero(order == k)]).astype(np.int64) for k in range(order.max() + 1)]


def learned(groups: DataFrame, answers: DataFrame, model: Model) -> None:
    """Loads the sums of what each group's words teach, from the groups that are there to learn from."""
    held = groups.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), None
        for batch in batches:
            for raw, answer in zip(batch.column("docs"), batch.column("answers")):
                found = group_learns(held.value, grams_of(raw, reader)[1], totals_of(answer))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    teaching = with_answers(groups.filter("learns"), answers.filter(F.col("id").startswith("-")))
    sums = teaching.mapInArrow(lean(learn), "k long, v long").groupBy("k").agg(F.sum("v")).collect()
    held.unpersist()
    sizes = [len(m.state()) for m in (model.flags, model.bits)]
    total = np.zeros(sum(sizes), np.int64)
    for k, v in sums:
        total[k] = v
    model.flags.load(total[: sizes[0]])
    model.bits.load(total[sizes[0] :])


def base_scored(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """The columns of ``scored`` that words' counts give alone: no pair or triple is counted, and no weight learned."""
    spark = docs.sparkSession
    groups = packed_groups(docs, folds, fold)
    release(spark)
    slabs = max(1, math.ceil((groups.agg(F.sum("n_bytes")).first()[0] or 0) * 0.37 / SLAB))
    answers = answered(asked(groups, slabs, 1), parts_for(spark, slabs, 1))
    release(spark)
    total, distinct, _, _ = tree_words(answers)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for raw, answer in zip(batch.column("docs"), batch.column("answers")):
                table, grams = grams_of(raw, reader)
                found = base_columns(grams, grams.counts(0, totals_of(answer)[0])[0], total, distinct)
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), *(pa.array(found[c]) for c in ("n_tokens", "n_known", "base_score"))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_answers(groups, answers.filter("id IS NOT NULL")).mapInArrow(lean(score), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score")


def scored(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """A row for each document; documents of ``fold`` are held out, and all others teach counts and weights."""
    spark = docs.sparkSession
    groups = packed_groups(docs, folds, fold)
    release(spark)
    train, size = groups.agg(F.sum("n_train"), F.sum("n_bytes")).first()
    slabs = max(1, math.ceil((size or 0) * 0.37 / SLAB))
    answers = answered(asked(groups, slabs), parts_for(spark, slabs, 1))
    release(spark)
    total, distinct, hashes, counts = tree_words(answers)
    by_hash = np.argsort(hashes)
    rest = total - int(counts.sum()) + 1
    model = Model(total, distinct, train or 0, hashes[by_hash], by_hash, counts, tree_of([*counts.tolist(), rest]), *mixers())
    learned(groups, answers, model)
    release(spark)
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for raw, answer in zip(batch.column("docs"), batch.column("answers")):
                table, grams = grams_of(raw, reader)
                found = group_scores(held.value, grams, totals_of(answer))
                size = pa.compute.binary_length(table["text"]).to_numpy()
                columns = [table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), *(pa.array(found[c]) for c in ("n_tokens", "n_known", "base_score", "score")), pa.array(size.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_answers(groups, answers.filter("id IS NOT NULL")).mapInArrow(lean(score), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's counts and base score, which SQL can tell; the score to six places, as sums of logarithms depend on their order."""
    found = base_scored(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


#: CRC-32 of the id's digits by the table of its bytes, then counts of all training words, for each row; for DuckDB.
BASE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS digits FROM documents),
b AS (SELECT range AS x, range AS v, 0 AS k FROM range(256) UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM b WHERE k < 8),
c AS (SELECT list(v ORDER BY x) AS crc FROM b WHERE k = 8),
h AS (SELECT r, doc_id, text, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(digits, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a & 255, x) + 1)::BIGINT])), 4294967295) % 5 = 1, FALSE) AS held_out FROM d, c),
w AS (SELECT r, doc_id, held_out, unnest(list_append(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ')) AS word FROM h),
n AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word), t AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM n)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(t.n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (t.n + 0.5 * (t.v + 1)))), 6) AS base_score FROM w LEFT JOIN n USING (word), t GROUP BY r, doc_id, held_out
"""
