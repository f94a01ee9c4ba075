"""Small control files on any file system that Spark reaches: write-once, conditional and read back."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class ConflictError(ValueError):
    """One name or id with two contents."""


class UnknownWriteError(OSError):
    """A write that failed without saying whether it took place."""


#: Names that a file system may reserve.
RESERVED = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


def canonical_json(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False) + "\n").encode()


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def safe_path(value: str) -> bool:
    """A relative path of plain names: no way up, no reserved or hidden names, no characters that a store may change."""
    parts = value.split("/")
    plain = all(re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.=-]*", p) and not p.endswith(".") and p.split(".")[0].lower() not in RESERVED for p in parts)
    return bool(value) and plain and len(value) <= 512


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here


def read(spark: SparkSession, path: str, limit: int = 1 << 26) -> bytes | None:
    """The content, or None without the file; more than ``limit`` bytes raise, and so does a file that was changed behind the file system's back."""
    fs, here = at(spark, path)
    if not fs.exists(here):
        return None
    if fs.getFileStatus(here).getLen() > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    stream = fs.open(here)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    except Exception as failed:
        if "ChecksumException" in str(failed):
            raise ConflictError(f"{path} is damaged") from failed
        raise
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: bytes) -> None:
    fs, here = at(spark, path)
    stream = fs.create(here, False)
    try:
        stream.write(bytearray(content), 0, len(content))
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Creates a file; True if it was not there. The same bytes again are no change, others raise."""
    held = read(spark, path)
    if held is None:
        try:
            _create(spark, path, content)
        except Exception:
            held = read(spark, path)
            if held is None:
                raise
        else:
            return True
    if held != content:
        raise ConflictError(f"{path} has other content")
    return False


def listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Relative path and size of every file below a folder."""
    fs, here = at(spark, folder)
    if not fs.exists(here):
        return {}
    root = fs.makeQualified(here).toString().rstrip("/") + "/"
    files, found = fs.listFiles(here, True), {}
    while files.hasNext():
        one = files.next()
        found[one.getPath().toString().removeprefix(root)] = one.getLen()
    return dict(sorted(found.items()))


def remove(spark: SparkSession, path: str) -> None:
    fs, here = at(spark, path)
    fs.delete(here, True)


@dataclass
class ObjectStore:
    """Objects by key, put only if the one that is there is the one expected. One writer at a time for each key."""

    spark: SparkSession
    root: str

    def _path(self, key: str) -> str:
        if not safe_path(key):
            raise ValueError(f"{key!r} is no plain path")
        return f"{self.root}/{key}"

    def get(self, key: str, limit: int = 1 << 26) -> tuple[bytes, str] | None:
        """(content, tag), or None without the object."""
        found = read(self.spark, self._path(key), limit)
        return None if found is None else (found, sha256(found))

    def put(self, key: str, content: bytes, expected: str | None = None) -> str:
        """Its new tag. Without an expected tag the key must be free; with one, the object must have it."""
        path, held = self._path(key), self.get(key)
        if (held[1] if held else None) != expected:
            raise ConflictError(f"{key} is not as expected")
        aside = f"{path}.{uuid.uuid4().hex}"
        if held is None:
            try:
                _create(self.spark, path, content)
            except Exception as failed:
                found = self.get(key)
                if found is not None and found[0] != content:
                    raise ConflictError(f"{key} was put by another writer") from failed
                if found is None:
                    raise UnknownWriteError(key) from failed
        else:
            _create(self.spark, aside, content)
            fs, here = at(self.spark, path)
            fs.delete(here, False)
            if not fs.rename(at(self.spark, aside)[1], here):
                raise UnknownWriteError(key)
        found = self.get(key)
        if found is None or found[0] != content:
            raise UnknownWriteError(key)
        return found[1]
