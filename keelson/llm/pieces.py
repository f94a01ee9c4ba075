"""SentencePiece encoding by vectorised merge rounds, and decoding.

Texts fall into words at each run of the space symbol, as no piece goes across one. The symbols of many
words lie in flat numpy arrays; a round finds each word's best pair, merges its occurrences from the left,
compacts the arrays and looks up the pairs beside each merge, until no word has a pair that the model
knows. A merge can in principle make a better pair than the one just merged; a word where that happens is
done again with one merge to a round, which is the order of the library. Each distinct word is merged once
and remembered.

Edge cases: a null or empty text has just the begin and end ids and decodes to an empty text; characters
that the model doesn't know become the ids of their bytes; whole texts of any length are encoded; a null
doc_id keeps its row; repeated rows are repeated.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, mix64, texts

SPACE = "▁"
#: Distinct words whose ids a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 700_000
NONE = np.int64(1 << 40)


class PairTable:
    """(left symbol, right symbol) -> rank, symbol: hashed slots, and further tables for keys that collide."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        while len(keys):
            seed = mix64(np.array([len(self.levels)], np.uint64))[0]
            bits = max(6, int(np.ceil(np.log2(len(keys)))) + 3)
            slot = self.slot(keys, seed, bits)
            order = np.argsort(slot, kind="stable")
            first = np.r_[True, slot[order][1:] != slot[order][:-1]]
            held_keys, held_values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
            held_keys[slot[order[first]]], held_values[slot[order[first]]] = keys[order[first]], values[order[first]]
            self.levels.append((seed, bits, held_keys, held_values))
            keys, values = keys[order[~first]], values[order[~first]]

    @staticmethod
    def slot(keys: np.ndarray, seed: np.uint64, bits: int) -> np.ndarray:
        return (mix64(keys.view(np.uint64) ^ seed) >> np.uint64(64 - bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        out = np.full(len(keys), NONE, np.int64)
        for seed, bits, held_keys, held_values in self.levels:
            slot = self.slot(keys, seed, bits)
            out = np.where(held_keys[slot] == keys, held_values[slot], out)
        return out


class Encoder:
    """The library's ids for whole texts; ``path`` is a BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)])
        pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model has pieces that go across words")
        self.symbol = {p: i for p, i in pieces.items() if len(p) == 1}
        for p in pieces:
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol))
        known = pieces | self.symbol
        by_score = {i: k for k, i in enumerate(sorted(pieces.values(), key=lambda i: -sp.get_score(i)))}
        pairs = [(known[p[:k]] << 32 | known[p[k:]], by_score[i] << 20 | i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs)))
        self.pieces = n
        self.words: dict[str, bytes] = {}
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*").findall

    def merged(self, words: list[str], one: bool = False) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        characters = [c for w in words for c in w]
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.r_[0, np.cumsum(size)[:-1]]
        symbols = np.fromiter((self.symbol.get(c, -1) for c in characters), np.int64, len(characters))
        place = np.arange(len(symbols))
        word = np.repeat(np.arange(len(words)), size)
        ended = np.full(len(symbols), -2, np.int64)  # the final symbol that starts at a character; -2: inside another one
        again = np.zeros(len(words), bool)
        rank = self.ranks(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            live = low < NONE
            each = np.diff(np.r_[first, len(word)])
            going = np.repeat(live, each)
            ended[place[~going]] = symbols[~going]
            if not live.all():
                symbols, place, word, rank = symbols[going], place[going], word[going], rank[going]
                low, each = low[live], each[live]
                if not len(symbols):
                    break
            best = np.flatnonzero(rank == np.repeat(low, each))
            if one:
                best = best[np.r_[True, word[best][1:] != word[best][:-1]]]
            else:
                chain = np.flatnonzero(np.r_[True, best[1:] != best[:-1] + 1])
                step = np.arange(len(best)) - np.repeat(chain, np.diff(np.r_[chain, len(best)]))
                best = best[step % 2 == 0]
            used = rank[best]
            symbols[best] = used & 0xFFFFF
            stays = np.ones(len(symbols), bool)
            stays[best + 1] = False
            at = np.cumsum(stays) - 1
            symbols, place, word, rank = symbols[stays], place[stays], word[stays], rank[stays]
            at = at[best]
            rank[at] = self.ranks_at(symbols, word, at)
            before = at - 1
            has = (before >= 0) & (word[before] == word[at])
            rank[before[has]] = self.ranks_at(symbols, word, before[has])
            if not one:
                again[word[at[rank[at] < used]]] = True
                again[word[at[has][rank[before[has]] < used[has]]]] = True
        out = self.ids(characters, ended, starts)
        if again.any():
            for i, ids in zip(np.flatnonzero(again).tolist(), self.merged([words[i] for i in np.flatnonzero(again)], True)):
                out[i] = ids
        return out

    def ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.ranks_at(symbols, word, np.arange(len(symbols)))

    def ranks_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and symbol of the pair that starts at each place; NONE without one."""
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.pairs.look_up(symbols[at], symbols[after])
        return np.where((after > at) & (word[after] == word[at]), found, NONE)

    def ids(self, characters: list[str], ended: np.ndarray, starts: np.ndarray) -> list[bytes]:
        final = np.flatnonzero(ended != -2)
        symbols = ended[final]
        plain = (symbols >= 0) & (symbols < self.pieces)
        coded = [characters[i].encode() for i in final[~plain].tolist()]
        count = np.ones(len(final), np.int64)
        count[~plain] = list(map(len, coded))
        out = np.empty(int(count.sum()), "<u4")
        spread = np.repeat(plain, count)
        out[spread] = symbols[plain]
        out[~spread] = self.bytes[np.frombuffer(b"".join(coded), np.uint8)]
        ends = np.r_[0, np.cumsum(count)][np.searchsorted(final, np.r_[starts, len(characters)])] * 4
        whole, ends = out.tobytes(), ends.tolist()
        return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def prepared(self, found: list[str]) -> list[np.ndarray]:
        """Ids of each text, begin and end included; the texts' new words are merged together first."""
        plain = [w for t in found if t and not self.odd(t) for w in t.split(" ")]
        self.learn(plain, False)
        self.learn([w for t in found if t and self.odd(t) for w in self.cut(SPACE + t.replace(" ", SPACE))], True)
        return self.encode(found)

    @staticmethod
    def odd(text: str) -> bool:
        return text[0] == " " or "  " in text or SPACE in text

    def encode(self, found: list[str]) -> list[np.ndarray]:
        out = []
        for text in found:
            coded = b""
            if text:
                marked = self.odd(text)
                words = self.cut(SPACE + text.replace(" ", SPACE)) if marked else text.split(" ")
                try:
                    coded = b"".join(map(self.words.__getitem__, words))
                except KeyError:
                    self.learn(words, marked)
                    coded = b"".join(map(self.words.__getitem__, words))
            ids = np.empty(len(coded) // 4 + 2, "<u4")
            ids[0], ids[-1] = self.begin, self.end
            ids[1:-1] = np.frombuffer(coded, "<u4")
            out.append(ids)
        return out

    def learn(self, words: list[str], marked: bool) -> None:
        """``words`` begin with the space symbol, or are understood to."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.words.update(zip(part, self.merged(part if marked else [SPACE + w for w in part])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a worker process; what it remembers serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, batch: int = 512) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""
    path = path or model_path()

    def step(rows: pa.RecordBatch, coder: Encoder) -> dict:
        ids, decoded = [], []
        column = rows.column("text")
        for i in range(0, rows.num_rows, batch):
            found = coder.prepared(column.slice(i, batch).to_pylist())
            ids += found
            decoded += [coder.library.decode(x.tolist()) for x in found]
        return {"doc_id": rows.column("doc_id"), "ids": ids, "decoded": decoded}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(texts(docs), step, f"doc_id {kind}, ids array<int>, decoded string", lambda: encoder(path))


def digests(docs: DataFrame, path: str | None = None, batch: int = 512) -> DataFrame:
    """doc_id, the number of ids, and the digests of ids and decoded text."""
    path = path or model_path()

    def step(rows: pa.RecordBatch, coder: Encoder) -> dict:
        n, ids_sha, text_sha = [], [], []
        column = rows.column("text")
        for i in range(0, rows.num_rows, batch):
            for ids in coder.prepared(column.slice(i, batch).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(coder.library.decode(ids.tolist()).encode()).hexdigest())
        return {"doc_id": rows.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(texts(docs), step, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: encoder(path))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: a row for each document that came so far, with its ids' and decoded text's digests.

    A null or empty text has the begin and end ids alone; rows that repeat are each reported; a null doc_id
    keeps its row; an empty table gives none.
    """
    return digests(docs)
