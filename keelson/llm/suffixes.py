"""Repeated substrings across documents, by merging shard Burrows-Wheeler transforms.

Only texts that can share a string are compared. Every window of ``length`` bytes has a minimiser: the
smallest hash of the ``GRAM``-byte strings in it. Equal windows have equal minimisers, so a window whose
minimiser no other text has is unique, and windows with one minimiser can be compared apart from all
others. Consecutive windows with one minimiser form a snippet. The snippets that meet in a task are dealt
to shards; each shard's suffixes are sorted and give its transform. The transforms are merged by iterative
interleave refinement (Holt and McMillan): the interleave of the shards by k symbols follows from that by
k - 1 symbols and the transforms alone, and so do the blocks of suffixes with a common prefix of k
symbols. After ``length`` rounds a block is a repeated interval; a window of it is removed from each
document with a larger doc_id than the smallest in the block. Snippets none of whose windows has a hash
that another document's has stay out of the merge: nothing of theirs can repeat.

What a task can decide by itself it does not send: texts that share a minimiser within the task, and
snippets that are equal to one of a smaller document. So a passage of very many documents costs each task
a row. Equal texts are one text, of the smallest doc_id; its copies are removed whole.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; a null doc_id counts as the
largest; rows of one doc_id never remove bytes from each other; repeated rows are each reported; texts of
any length are processed whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, by_key, column_bytes, documents, input_bytes, kept, lean, map_rows, mix64, parts_for, release, runs

#: Bytes of the strings that minimisers are taken from.
GRAM = 20
#: Most windows to a snippet; a longer stretch is cut at multiples of it.
STRETCH = 256
#: Bytes of snippets that are merged at once, and to a shard.
MERGED, SHARD = 1 << 20, 1 << 18
#: Takes the place of a null doc_id.
LAST = (1 << 63) - 1

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


#: What a task sends on of its minimisers, and the number that stands for several of its texts.
PACKED = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("packed", pa.binary()), ("number", pa.binary()), ("owners", pa.binary())])
ANY = 65535


def string_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes, from those of spans that double."""
    span, value, held = 1, _BYTE[text], {}
    factor = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    while span <= length:
        held[span] = value
        if 2 * span <= length:
            value = value[:-span] * factor + value[span:]
        factor = factor * factor
        span *= 2
    whole, at, n = None, 0, len(text) - length + 1
    for b in sorted((b for b in held if length & b), reverse=True):
        part = held[b][at : at + n]
        whole = part.copy() if whole is None else whole * np.uint64(0xD6E8FEB86659FD93) + part
        at += b
    return mix64(whole)


def window_minimisers(text: np.ndarray, length: int) -> np.ndarray:
    """The minimiser of each window of ``length`` bytes; none for a shorter text."""
    if len(text) < length:
        return np.zeros(0, np.uint64)
    low = string_hashes(text, GRAM)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def stretches(minimisers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of windows of each stretch with one minimiser."""
    start = np.flatnonzero(np.r_[True, minimisers[1:] != minimisers[:-1]])
    return start, np.diff(np.r_[start, len(minimisers)])


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of one shard in order, by ``depth`` symbols at least, and its transform, one and two symbols back.

    The shard is read as a ring; snippets end with a symbol of their own, so that no suffix that counts
    reaches past its snippet.
    """
    n = len(symbols)
    packed = np.zeros(n, np.uint64)
    for i in range(7):
        packed = packed << np.uint64(9) | np.roll(symbols, -i).astype(np.uint64)
    reach, order = 7, np.argsort(packed)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, packed[order][1:] != packed[order][:-1]])
    while reach < depth and rank[order[-1]] < n - 1:
        key = rank * n + np.roll(rank, -reach)
        order = np.argsort(key)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        reach *= 2
    return order, symbols[order - 1], symbols[order - 2]


def merged_blocks(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards in order of ``depth`` symbols, and whether each place starts a new block.

    A shard gives, for each suffix in order, the symbol before it and the one before that. The interleave
    holds a shard number for each place; the j-th place of a shard is its j-th suffix. A round deals each
    shard's symbols out along the interleave and sorts it by them, stably; it takes two symbols at once
    where pairs of them have 16 bits.
    """
    one, two = (np.concatenate(x) for x in zip(*transforms))
    codes = np.zeros(int(one.max(initial=0)) + 1, np.uint16)
    used = np.unique(one)
    codes[used] = np.arange(len(used))
    one, two = codes[one], codes[two]
    pairs = (two * np.uint16(len(used)) + one) if len(used) <= 256 else None
    if len(used) <= 256:
        one = one.astype(np.uint8)
    size = [len(t[0]) for t in transforms]
    place = np.repeat(np.arange(len(size), dtype=np.uint8 if len(size) <= 256 else np.uint16), size)
    block = np.zeros(len(one), np.int32)
    new = np.zeros(len(one), bool)
    done = 0
    while done < depth:
        step = 2 if pairs is not None and depth - done >= 2 else 1
        dealt = pairs if step == 2 else one
        symbol = np.empty_like(dealt)
        symbol[np.argsort(place, kind="stable")] = dealt
        order = np.argsort(symbol, kind="stable")
        symbol, place, block = symbol[order], place[order], block[order]
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32)
        done += step
    new[:1] = True
    return place, new


def repeated_windows(snippets: list[bytes], windows: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows also start in a snippet of a smaller document, one flag for each byte of the snippets and of the mark behind each; and where each snippet starts."""
    size = np.array([len(s) + 1 for s in snippets])
    ends = np.cumsum(size)
    cut = np.flatnonzero(np.r_[True, (ends[1:] - 1) // SHARD != (ends[:-1] - 1) // SHARD])
    orders, transforms = [], []
    starts = ends - size
    for a, b in zip(cut, np.r_[cut[1:], len(snippets)]):
        raw = np.frombuffer(b"\0".join(snippets[a:b]) + b"\0", np.uint8).astype(np.uint16) + 1
        raw[ends[a:b] - starts[a] - 1] = 0
        order, *back = transform(raw, length)
        orders.append(order + starts[a])
        transforms.append(tuple(back))
    place, first = merged_blocks(transforms, length)
    at = np.empty(len(place), np.int64)
    at[np.argsort(place, kind="stable")] = np.concatenate(orders)
    which = np.searchsorted(ends, at, side="right")
    counts = at - starts[which] < windows[which]
    owner = np.where(counts, docs[which], LAST)
    block = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(owner, block), np.diff(np.r_[block, len(place)]))
    removed = np.zeros(int(ends[-1]), bool)
    removed[at[counts & (least < docs[which])]] = True
    return removed, starts


def may_repeat(snippets: list[bytes], windows: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which snippets have a window whose hash a snippet of another document has too: without one, no window of theirs repeats."""
    size = np.array([len(s) for s in snippets])
    starts = np.cumsum(size) - size
    h = string_hashes(np.frombuffer(b"".join(snippets), np.uint8), length)
    which = np.repeat(np.arange(len(snippets)), windows)
    h = h[np.arange(len(which)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)]
    order = np.argsort(h)
    which, h = which[order], h[order]
    d = docs[which]
    begin, end = runs(h)
    several = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
    out = np.zeros(len(snippets), bool)
    out[which[np.repeat(several, end - begin)]] = True
    return out


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edges[::2], edges[1::2]


def hash_bytes(amount: int) -> int:
    """Leading bytes of a minimiser that tell minimisers of ``amount`` bytes of text apart, but for one in 256.

    Two that agree in these bytes by chance are only compared in vain.
    """
    return min(8, max(4, -(-(max(amount, 1).bit_length() - 4 + 8) // 8)))


def clipped(minimisers: np.ndarray, width: int) -> np.ndarray:
    return minimisers >> np.uint64(64 - 8 * width)


def shared_minimisers(rows: DataFrame, length: int, amount: int) -> DataFrame:
    """(t, hashes): the clipped minimisers that each text shares with another one. ``amount`` estimates the texts' bytes.

    A task packs its minimisers for each partition into one row: sorted, with the number of their text
    in the task, and the texts. Those that two of its texts share are decided there; of each, one goes on,
    marked by the text number ``ANY``.
    """
    width = hash_bytes(amount)
    parts = parts_for(rows.sparkSession, int(amount * 0.06), 1_500_000)
    most = 60_000

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(hashes)
            which = np.repeat(np.arange(len(hashes), dtype=np.uint16), [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            h, which, ts = h[order], which[order], np.array(owners, np.int64)
            t = ts[which]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            several = np.minimum.reduceat(t, start) != np.maximum.reduceat(t, start)
            here = np.repeat(several, size)
            if here.any():
                own = np.unique(np.stack([t[here], h[here].view(np.int64)], axis=1), axis=0)
                for i in range(0, len(own), 1 << 16):
                    part = own[i : i + (1 << 16)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0] % parts), pa.array(part[:, 0]), pa.array(part[:, 1]), *(pa.nulls(n, pa.binary()) for _ in range(3))], schema=PACKED)
            alone = ~here
            alone[start[several]] = True
            which[start[several]] = ANY
            h, which = h[alone], which[alone]
            to = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            h, which, to = h[order], which[order], to[order]
            for a, b in zip(*runs(to)):
                found, number = np.unique(np.r_[which[a:b], np.uint16(ANY)], return_inverse=True)
                packed = h[a:b].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 1]), pa.array([0]), pa.array([0]), pa.array([packed], pa.binary()), pa.array([number[:-1].astype("<u2").tobytes()], pa.binary()), pa.array([ts[found[:-1]].tobytes()], pa.binary())], schema=PACKED)

        hashes, owners, held = [], [], 0
        for batch in batches:
            for text, t in zip(column_bytes(batch.column("text")), batch.column("t").to_pylist()):
                found = np.unique(clipped(window_minimisers(np.frombuffer(text, np.uint8), length), width))
                if not len(found):
                    continue
                hashes.append(found)
                owners.append(t)
                held += len(found)
                if held > 2_000_000 or len(owners) == most:
                    yield from flush()
                    hashes, owners, held = [], [], 0
        if hashes:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ts, marks = [], [], []
        for batch in batches:
            packed = batch.column("packed")
            done = batch.filter(packed.is_null())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column("t"), done.column("h")], names=["t", "h"])
            for raw, number, owners in zip(packed, batch.column("number"), batch.column("owners")):
                if not raw.is_valid:
                    continue
                wide = np.zeros((len(raw.as_buffer()) // width, 8), np.uint8)
                wide[:, :width] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, width)
                owners = np.frombuffer(owners.as_buffer(), np.int64)
                number = np.frombuffer(number.as_buffer(), "<u2").astype(np.int64)
                mark = number >= len(owners)
                hs.append(wide.view(np.uint64).ravel())
                ts.append(np.where(mark, 0, np.r_[owners, 0][np.minimum(number, len(owners))]))
                marks.append(mark)
        if not hs:
            return
        h, t, mark = np.concatenate(hs), np.concatenate(ts), np.concatenate(marks)
        order = np.argsort(h, kind="stable")
        h, t, mark = h[order], t[order], mark[order]
        start, _ = runs(h)
        size = np.diff(np.r_[start, len(h)])
        low = np.minimum.reduceat(np.where(mark, LAST, t), start)
        high = np.maximum.reduceat(np.where(mark, -LAST, t), start)
        shared = (low < high) | (np.maximum.reduceat(mark, start) & (size > 1))
        out = np.repeat(shared, size) & ~mark
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(h[out].view(np.int64))], names=["t", "h"])

    sent = rows.select("t", "text").mapInArrow(lean(send), "key long, t long, h long, packed binary, number binary, owners binary").repartition(parts, "key")
    return sent.mapInArrow(lean(decide), "t long, h long").groupBy("t").agg(F.collect_set("h").alias("hashes"))


def united(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


SENT = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("t", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("content", pa.binary())])
SENT_DDL = "key long, h long, d long, t array<long>, a array<int>, b array<int>, content binary"
SPANS_DDL = "t long, a array<int>, b array<int>"


class Snippets:
    """Distinct snippets with the smallest document that has them; what is found beside it is removed."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.found: dict[tuple[int, bytes], tuple[int, list[int], list[int]]] = {}
        self.removed: dict[int, list[tuple[int, int]]] = {}

    def remove(self, ts: list[int], at: list[int], content: bytes) -> None:
        for t, a in zip(ts, at):
            self.removed.setdefault(t, []).append((a, a + len(content)))

    def add(self, h: int, content: bytes, d: int, ts: list[int], at: list[int]) -> None:
        before = self.found.get((h, content))
        if before is None or before[0] > d:
            if before:
                self.remove(before[1], before[2], content)
            self.found[h, content] = (d, ts, at)
        elif before[0] < d:
            self.remove(ts, at, content)
        else:
            before[1].extend(ts)
            before[2].extend(at)

    def removals(self) -> list[tuple[int, list[int], list[int]]]:
        return [(t, *united(spans)) for t, spans in self.removed.items()]


def spread(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of lists, and how many each has."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()


def decided(table: pa.Table, length: int) -> pa.RecordBatch:
    """The intervals to remove that whole groups of one minimiser give: of equal snippets, of repeated windows, and those that tasks found before."""
    before = table["content"].is_null()
    done, table = table.filter(before), table.filter(pa.compute.invert(before))
    a, many = spread(done["a"])
    spans = [(np.repeat(spread(done["t"])[0], many), a, spread(done["b"])[0])]
    h, d = table["h"].to_numpy(), table["d"].to_numpy()
    code = table["content"].combine_chunks().dictionary_encode()
    size = pa.compute.binary_length(code.dictionary).to_numpy()
    code = code.indices.to_numpy()
    order = np.lexsort((d, code, h))
    h, d, code = h[order], d[order], code[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])]) if len(h) else np.zeros(0, int)
    item = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
    table = table.take(pa.array(order))
    t, many = spread(table["t"])
    at = spread(table["a"])[0]
    item, gone = np.repeat(item, many), np.repeat(d > d[first][item], many)
    width = size[code[first]]
    spans.append((t[gone], at[gone], at[gone] + width[item[gone]]))
    begin, end = runs(h[first])
    some = np.flatnonzero(np.repeat(end - begin, end - begin) > 1)
    if len(some):
        some = some[may_repeat(table["content"].take(pa.array(first[some])).to_pylist(), width[some] - length + 1, d[first][some], length)]
    if len(some):
        content = table["content"].take(pa.array(first[some])).to_pylist()
        windows, docs = width[some] - length + 1, d[first][some]
        removed, starts = repeated_windows(content, windows, docs, length)
        x, y = true_runs(removed)
        which = np.searchsorted(starts, x, side="right") - 1
        x, y = x - starts[which], y - starts[which] + length - 1
        place = np.full(len(first), -1)
        place[some] = np.arange(len(some))
        mine = np.flatnonzero(~gone & (place[item] >= 0))
        mine = mine[np.argsort(place[item[mine]], kind="stable")]
        begin, end = (np.searchsorted(place[item[mine]], which, side=s) for s in ("left", "right"))
        times = end - begin
        each = mine[np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        spans.append((t[each], at[each] + np.repeat(x, times), at[each] + np.repeat(y, times)))
    return united_spans(*(np.concatenate(c) for c in zip(*spans)))


def united_spans(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(t, a, b): the maximal runs that spans cover, in a row for each text."""
    order = np.lexsort((a, t))
    t, a, b = t[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if len(t):
        shift = np.cumsum(np.r_[0, t[1:] != t[:-1]]) << 33
        reach = np.maximum.accumulate(b + shift)
        begin = np.flatnonzero(np.r_[True, (a + shift)[1:] > reach[:-1]])
        t, a, b = t[begin], a[begin], np.maximum.reduceat(b, begin)
    starts, _ = runs(t)
    offsets = pa.array(np.r_[starts, len(t)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(t[starts].astype(np.int64)), *lists], names=["t", "a", "b"])


def removed_intervals(rows: DataFrame, length: int, amount: int) -> DataFrame:
    """(t, a, b): starts and ends of byte intervals to remove, from (t, d, text, hashes)."""
    width = hash_bytes(amount)

    def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 20_000]), SENT)], schema=SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: Snippets) -> Iterator[pa.RecordBatch]:
            yield from rows_of([(t, 0, 0, [t], a, b, None) for t, a, b in held.removals()])
            yield from rows_of([(h, h, d, t, a, [], content) for (h, content), (d, t, a) in held.found.items()])

        held, size = Snippets(length), 0
        for batch in batches:
            for text, t, d, hashes in zip(column_bytes(batch.column("text")), batch.column("t").to_pylist(), batch.column("d").to_pylist(), batch.column("hashes")):
                minimisers = window_minimisers(np.frombuffer(text, np.uint8), length)
                if not len(minimisers):
                    continue
                start, windows = stretches(minimisers)
                h = minimisers[start].view(np.int64)
                shared = np.isin(clipped(minimisers[start], width).view(np.int64), hashes.values.to_numpy()) if hashes.is_valid else np.ones(len(start), bool)
                for p, n, g in zip(start[shared].tolist(), windows[shared].tolist(), h[shared].tolist()):
                    for q in range(p, p + n, STRETCH):
                        content = text[q : min(q + STRETCH, p + n) + length - 1]
                        held.add(g, content, d, [t], [q])
                        size += len(content) + 300
            if size > 40 << 20:
                yield from flush(held)
                held, size = Snippets(length), 0
        yield from flush(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in by_key(batches, "h", 4096):
            held.append(table)
            size += table["content"].nbytes
            if size > 2 * MERGED:
                yield decided(pa.concat_tables(held), length)
                held, size = [], 0
        if held:
            yield decided(pa.concat_tables(held), length)

    parts = parts_for(rows.sparkSession, amount, 24 << 20)
    sent = rows.select("t", "d", "text", "hashes").mapInArrow(lean(send), SENT_DDL)
    return sent.repartition(parts, "key").sortWithinPartitions("h").mapInArrow(lean(merge), SPANS_DDL)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def marked(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of ``docs`` with d, whole (a copy of a smaller document), and the starts and ends of what to remove.

    A text is told by two hashes, 128 bits. Where different texts agree in the first one, they get names
    of their own, and all their minimisers count as shared.
    """
    columns = docs.columns
    amount = 2 * input_bytes(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*columns, F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("d"), text_hash(text).cast("long").alias("t"), F.xxhash64(F.lit(1), text).alias("u"))
    plain = rows.select("d", "t", "u", text.alias("text"))
    keys = kept(rows.select("d", "t", "u").distinct())
    first = keys.groupBy("t", "u").agg(F.min("d").alias("least"))
    per_hash = first.groupBy("t").agg(F.min("u").alias("u0"), F.count("*").alias("texts"))
    named = first.join(per_hash, "t").select("t", "u", "least", "texts", F.when(F.col("u") == F.col("u0"), F.col("t")).otherwise(F.xxhash64("t", "u")).alias("name"))
    named = kept(named)
    found = shared_minimisers(plain.select("t", "text"), length, amount)
    shared = named.join(found, "t", "left").filter("hashes IS NOT NULL OR texts > 1")
    shared = kept(shared.select(F.col("t").alias("its_t"), F.col("u").alias("its_u"), "least", "name", F.when(F.col("texts") == 1, F.col("hashes")).alias("hashes")))
    some = plain.join(shared, (plain.t == shared.its_t) & (plain.u == shared.its_u) & (plain.d == shared.least)).select(F.col("name").alias("t"), "d", "text", "hashes")
    release(docs.sparkSession)
    spans = kept(removed_intervals(some, length, amount))
    release(docs.sparkSession)
    merged = spans.groupBy("t").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b")).withColumnRenamed("t", "name")
    side = keys.join(named, ["t", "u"]).withColumn("whole", F.col("d") > F.col("least"))
    none = F.lit(None).cast("array<int>")
    side = side.filter("whole").select("d", "t", "u", "whole", none.alias("a"), none.alias("b")).union(side.filter("not whole").join(merged, "name", "left").select("d", "t", "u", "whole", "a", "b"))
    its = side.select(F.col("d").alias("its_d"), F.col("t").alias("its_t"), F.col("u").alias("its_u"), "whole", "a", "b")
    return rows.join(its, (rows.d == F.col("its_d")) & (rows.t == F.col("its_t")) & (rows.u == F.col("its_u"))).drop("its_d", "its_t", "its_u")


def kept_bytes(text: bytes, whole: bool, a: list[int] | None, b: list[int] | None, length: int) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many runs."""
    if whole and len(text) >= length:
        return b"", len(text), 1
    starts, ends = united(list(zip(a or (), b or ())))
    out, at = [], 0
    for x, y in zip(starts, ends):
        out.append(text[at:x])
        at = y
    out.append(text[at:])
    left = b"".join(out)
    return left, len(text) - len(left), len(starts)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str, length: int = 50) -> DataFrame:
    rows = marked(documents(spark, sf_dir).select("doc_id", "text"), length).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "whole", "a", "b")

    def step(batch: pa.RecordBatch) -> dict:
        found = [(len(t), *kept_bytes(t, w, a, b, length)) for t, w, a, b in zip(column_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("whole", "a", "b")))]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [x[0] for x in found], "n_removed": [x[2] for x in found], "n_spans": [x[3] for x in found], "kept_sha256": [hashlib.sha256(x[1]).hexdigest() for x in found]}

    return map_rows(rows, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same by every window of 50 bytes as hexadecimal text, for DuckDB; texts are cut into parts first, as it reads a text whole for each window.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, k, n, substr(h, CAST(1024 * k + 1 AS BIGINT), 1122) AS h FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, (len(h) // 2 + 462) // 512)) AS k FROM d)),
w AS (SELECT doc_id, 512 * k + j AS i, substr(h, CAST(2 * j + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, k, h, unnest(range(0, least(512, n - 49 - 512 * k))) AS j FROM p)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
x AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE w.doc_id > least),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 50, true) AS first FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY ALL),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT)) AS h, sum(z - a) AS removed, count(*) AS spans FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = 50) -> DataFrame:
    """The documents without their repeated bytes; half characters at a cut go too, and n_chars counts what stays."""
    rows = marked(docs.select(*DOCUMENT_COLUMNS), length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else kept_bytes(t, w, a, b, length)[0].decode(errors="ignore") for t, w, a, b in zip(column_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("whole", "a", "b")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=DOCUMENT_COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select(*DOCUMENT_COLUMNS, "whole", "a", "b").mapInArrow(lean(cut), f"doc_id {kind}, text string, lang string, source string, n_chars long")
