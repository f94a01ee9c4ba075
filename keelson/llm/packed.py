"""Token ids in fixed-width bit-packed files.

A file holds blocks of ``BLOCK`` ids; each id takes the fewest bits that hold the largest id of the
vocabulary, lowest bit first. Blocks are padded to whole 64-bit words, and the footer lists their
offsets, the documents' ids and where each document starts, so that any range of ids is read and
unpacked by itself with numpy. Layout: magic, blocks, footer, footer length (uint64), magic.

Edge cases: a null or empty text holds just the end id; a null doc_id is kept and sorts first; rows
with one doc_id are ordered by their text; an empty table writes no document and reads back none.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, input_bytes, lean, parts_for, shared_dir, texts

MAGIC = b"BITPACK1"
BLOCK = 4096
#: Input bytes to a file, so that files and their rows at the driver stay few.
FILE_BYTES = 128 << 20
#: Distinct words and pieces in a generation of what a worker remembers.
REMEMBERED = 700_000
END_ID = 0
#: Texts of these characters alone are cut the same way by every release of Unicode; any other text goes to the library whole.
PLAIN = r"[\t\n\r\x20-\x7E¡-ɏ]*+"
#: A space beside other white space, as far as PLAIN has it.
TOUCHING = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits for each id, lowest first; padded to groups of 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= padded[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(content: bytes, n: int, width: int) -> np.ndarray:
    words = np.frombuffer(content, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(-1)[:n].astype(np.uint32)


class Writer:
    """Streams documents into one file; only the current block and the footer are held."""

    def __init__(self, sink: io.IOBase, vocabulary: int) -> None:
        self.sink, self.width = sink, max(1, (vocabulary - 1).bit_length())
        self.offsets, self.ids, self.lengths, self.rest = [len(MAGIC)], [], [], np.zeros(0, np.uint32)
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths.append(np.asarray(lengths, np.int64))
        flat = np.concatenate([self.rest, ids])
        whole = len(flat) // BLOCK * BLOCK
        if whole:
            content = pack(flat[:whole], self.width)
            size = len(content) * BLOCK // whole
            self.sink.write(content)
            self.offsets += range(self.offsets[-1] + size, self.offsets[-1] + len(content) + 1, size)
        self.rest = flat[whole:]

    def close(self) -> tuple[int, int]:
        lengths = np.concatenate([*self.lengths, np.zeros(0, np.int64)])
        if len(self.rest):
            content = pack(self.rest, self.width)
            self.sink.write(content)
            self.offsets.append(self.offsets[-1] + len(content))
        n = int(lengths.sum())
        null = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        footer = struct.pack("<5Q", self.width, BLOCK, n, len(ids), len(self.offsets)) + np.array(self.offsets, "<u8").tobytes() + ids.tobytes() + null.tobytes() + lengths.astype("<u8").tobytes()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return len(ids), n


class TokenFile:
    """Random access to one file, given a way to read a range of its bytes."""

    def __init__(self, read, size: int) -> None:
        tail = read(size - 8 - len(MAGIC), 8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a bit-packed token file")
        (length,) = struct.unpack("<Q", tail[:8])
        footer = read(size - 8 - len(MAGIC) - length, length)
        self.read = read
        self.width, self.block, self.n_ids, n, blocks = struct.unpack_from("<5Q", footer)
        self.offsets = np.frombuffer(footer, "<u8", blocks, 40).astype(np.int64)
        at = 40 + 8 * blocks
        self.doc_ids = np.frombuffer(footer, "<i8", n, at)
        self.null = np.frombuffer(footer, np.uint8, n, at + 8 * n).astype(bool)
        self.starts = np.r_[0, np.cumsum(np.frombuffer(footer, "<u8", n, at + 9 * n).astype(np.int64))]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``; only the blocks that hold them are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block + 1
        content = self.read(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack(content, n, self.width)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class Encoder:
    """The tokenizers library's ids of whole texts, as little-endian 32-bit integers.

    Merges never cross the pieces that the vocabulary's pattern cuts, and a single space between other
    characters always starts a piece. So a text falls into words, words into pieces, and the library's
    model encodes each distinct piece once while it is remembered. What a worker remembers has two
    generations: a word that is still in use moves to the young one, the old one goes when that is full.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.tokenize = self.library.model.tokenize
        self.words: dict[str, bytes] = {}  # after a space
        self.starts: dict[str, bytes] = {}  # pieces without one
        self.old: dict[str, bytes] = {}

    def encode(self, found: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in found:
            if any(s in text for s in self.special) or not (text.isascii() and text.isprintable() or self.plain(text)):
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
            elif text[:1] == " " or text[-1:] == " " or any(s in text for s in TOUCHING):
                out.append(b"".join(map(self.piece, self.cut(text))))
            else:
                first, *words = text.split(" ")
                try:
                    coded = b"".join(map(self.words.__getitem__, words))
                except KeyError:
                    for w in set(words).difference(self.words):
                        self.word(w)
                    coded = b"".join(map(self.words.__getitem__, words))
                out.append(b"".join(map(self.piece, self.cut(first))) + coded)
            if len(self.words) + len(self.starts) > REMEMBERED:
                self.old, self.words, self.starts = self.words, {}, {}
        return out

    def word(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        coded = self.old.get(word)
        if coded is None and word.isascii() and word.isalpha() and word.islower():  # one piece whatever the pattern says of cases
            coded = self.ids(self.space + word)
        elif coded is None:
            pieces = self.cut(f" {word}")
            coded = self.coded(pieces[0]) if len(pieces) == 1 else b"".join(map(self.piece, pieces))
        self.words[word] = coded
        return coded

    def piece(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1 and piece[1] != " ":
            return self.words.get(piece[1:]) or self.word(piece[1:])
        coded = self.starts.get(piece)
        if coded is None:
            coded = self.starts[piece] = self.coded(piece)
        return coded

    def coded(self, piece: str) -> bytes:
        return self.ids(piece.encode().decode("latin-1").translate(self.letters))

    def ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a worker process; what it remembers serves later tasks of the same worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents in ascending doc_id order; (file, n_docs, n_ids), a row for each file.

    A task writes its own file under another name and moves it when whole, so a task that is run again
    replaces its file.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path)
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"{TaskContext.get().partitionId():08d}.ids"
        held = f"{at}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(held) as sink:
            writer = Writer(sink, coder.vocabulary)
            for batch in batches:
                doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
                for i in range(0, batch.num_rows, 256):
                    coded = [x + end for x in coder.encode(column.slice(i, 256).to_pylist())]
                    writer.add(doc_ids[i : i + 256], np.frombuffer(b"".join(coded), "<u4"), [len(x) // 4 for x in coded])
            n_docs, n_ids = writer.close()
        store.move(held, f"{at}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "n_docs": n_docs, "n_ids": n_ids}])

    parts = parts_for(spark, input_bytes(docs), FILE_BYTES)
    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lean(run), "file string, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files; ``written`` has (file, n_ids), a row for each file.

    A task opens its files and reads them range by range, so that none is held whole.
    """
    sizes = sorted((r["file"], r["n_ids"]) for r in written.collect())
    before = np.r_[0, np.cumsum([n for _, n in sizes])].tolist()
    files = spark.createDataFrame([(name, start) for (name, _), start in zip(sizes, before)], "file string, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_file(f"{at}/{name}") as source:
                    found = TokenFile(lambda a, n, source=source: source.read_at(n, a), source.size())
                    for i in range(0, len(found.doc_ids), 2048):
                        starts = found.starts[i : i + 2049]
                        ids = found.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                        to = (starts - starts[0]) * 4
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(to[:-1], to[1:])]
                        columns = [pa.array(found.doc_ids[i : i + 2048], mask=found.null[i : i + 2048]), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(parts_for(spark, len(sizes), 8)).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    written = write_tokens(documents(spark, sf_dir), folder)
    return read_tokens(spark, folder, written.select("file", "n_ids"))
