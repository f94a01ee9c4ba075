"""Captures on executors: bytes stored once under their hash, and manifests that appear all at once.

Each task places the objects of its rows and writes a manifest file for each collection that it met, under
the name of its attempt. Nothing of a job is visible before its commit file, one write at the driver,
names the attempts that succeeded. Only their names go through the driver, never bytes or manifests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from hashlib import sha256
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import parse
from ..functions.checks import require
from ..session import ship
from .files import ConflictError, canonical_json

#: Facts of a manifest that are the same for all rows of a job.
FACTS = ("provider_namespace", "source_family", "retrieved_at", "adapter_version", "parser_version", "retention_class", "license_name")
MANIFEST = "capture_id string, collection string, name string, content_sha256 string, length long, parameters string, " + ", ".join(f"{f} string" for f in FACTS)


def object_path(digest: str) -> str:
    return f"raw/objects/{digest[:2]}/{digest}"


def place(store: fs.FileSystem, root: str, content: bytes) -> str:
    """Stores bytes under their hash, unless they are there; the hash. An object that is not what its name says raises."""
    digest = sha256(content).hexdigest()
    path = f"{root}/{object_path(digest)}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as sink:
            sink.write(content)
        store.move(aside, path)
    elif sha256(fetch(store, path)).hexdigest() != digest:
        raise ConflictError(f"{path} is not what its name says")
    return digest


def fetch(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as source:
        return source.read()


@dataclass
class Attempt(WriterCommitMessage):
    """The manifests of one task, by the name that its files have."""

    name: str
    files: list[str]


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.facts = {f: options.get(f) for f in FACTS}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, root = fs.FileSystem.from_uri(self.root)
        attempt, sinks = f"{self.job}-{uuid.uuid4().hex}", {}
        try:
            for batch in iterator:
                for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                    if not row["collection"] or "/" in row["collection"] or parse.names_secret(json.loads(row["parameters"] or "{}")):
                        raise ValueError("a collection is no plain name, or a parameter names a credential")
                    body = {"collection": row["collection"], "name": row["name"], "content_sha256": place(store, root, row["content"] or b""), "length": len(row["content"] or b""), "parameters": row["parameters"]} | self.facts
                    body["capture_id"] = str(uuid.uuid5(uuid.NAMESPACE_OID, canonical_json(body).decode()))
                    if row["collection"] not in sinks:
                        folder = f"{root}/raw/captured/{row['collection']}"
                        store.create_dir(folder, recursive=True)
                        sinks[row["collection"]] = f"{folder}/{attempt}.jsonl", store.open_output_stream(f"{folder}/{attempt}.jsonl")
                    sinks[row["collection"]][1].write(canonical_json(body))
        finally:
            for _, sink in sinks.values():
                sink.close()
        return Attempt(attempt, [path for path, _ in sinks.values()])

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(f"{root}/raw/commits", recursive=True)
        path = f"{root}/raw/commits/{self.job}"
        with store.open_output_stream(f"{path}.aside") as sink:
            sink.write(b"".join(canonical_json({"attempt": m.name}) for m in messages if m))
        store.move(f"{path}.aside", f"{path}.jsonl")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.root)
        for path in (p for m in messages if m for p in m.files):
            store.delete_file(path)


class Captures(DataSource):
    """``write.format("captures")``: rows (collection, name, content, parameters) below a root, with the facts as options."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options))


def capture_rows(rows: DataFrame, root: str, **facts: str) -> None:
    """Captures (collection, name, content, parameters); a collection's rows are best kept in one partition.

    Rows that come again (a retried task, a repeated job) give the same object and capture id.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Captures)
    rows.select("collection", "name", "content", "parameters").write.format("captures").mode("append").options(**facts).save(root)


def capture_folder(spark: SparkSession, folder: str, root: str, collection: str = "files", **facts: str) -> None:
    """Captures all files below a folder, by the executors that read them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    capture_rows(found.select(F.lit(collection).alias("collection"), F.col("path").alias("name"), "content", F.lit(None).cast("string").alias("parameters")), root, **facts)


def captured(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all committed jobs, each capture once."""
    commits = spark.read.schema("attempt string").json(f"{root}/raw/commits")
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{root}/raw/captured")
    rows = rows.withColumn("attempt", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    return rows.join(commits, "attempt", "left_semi").drop("attempt").dropDuplicates(["capture_id"])


class Collection:
    """The committed captures of one collection, by name, for a reader on an executor."""

    def __init__(self, root: str, name: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(root)
        committed: dict[str, set[str]] = {}
        self.manifests: dict[str, dict] = {}
        folder = f"{self.root}/raw/captured/{name}"
        for found in self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            attempt = found.base_name.removesuffix(".jsonl")
            job = attempt.partition("-")[0]
            if job not in committed:
                path = f"{self.root}/raw/commits/{job}.jsonl"
                there = self.store.get_file_info(path).type != fs.FileType.NotFound
                committed[job] = {json.loads(x)["attempt"] for x in fetch(self.store, path).splitlines()} if there else set()
            if attempt in committed[job]:
                for line in fetch(self.store, found.path).splitlines():
                    body = json.loads(line)
                    held = self.manifests.setdefault(body["name"], body)
                    if held["content_sha256"] != body["content_sha256"]:
                        raise ConflictError(f"{name}: {body['name']} was captured with two contents")

    def get(self, name: str) -> tuple[dict, bytes]:
        if name not in self.manifests:
            raise FileNotFoundError(f"{name} was not captured")
        body = self.manifests[name]
        content = fetch(self.store, f"{self.root}/{object_path(body['content_sha256'])}")
        if sha256(content).hexdigest() != body["content_sha256"]:
            raise ConflictError(f"{name}: the object is not what its name says")
        return body, content


BARS = "listing_id string, symbol string, session_date date, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume long, page int, observation_id string"
PAGES = "listing_id string, symbol string, page int, n_bars long, observation_id string, source_native_id string, content_sha256 string, retrieved_at string"
NEW_YORK = ZoneInfo("America/New_York")
#: Fixed value: the most pages of a chain.
MOST_PAGES = 100


@dataclass(frozen=True)
class Segment(InputPartition):
    """What is asked of one symbol: the days that it was the listing's, as far as they are wanted (both ends included)."""

    listing_id: str
    symbol: str
    first: date
    last: date

    @property
    def collection(self) -> str:
        return f"{self.symbol}_{self.first}_{self.last}"


def segments(symbols: list[tuple[str, str, date, date | None]], start: date, end: date) -> list[Segment]:
    """Segments of (listing_id, symbol, valid_from, valid_to), where valid_to is excluded, clipped to the days asked for."""
    found = (Segment(i, s, max(start, a), end if b is None else min(end, b - timedelta(days=1))) for i, s, a, b in symbols)
    return [x for x in found if x.first <= x.last]


class PagedBarsReader(DataSourceReader):
    """A partition for each segment; its chain of pages is followed where it is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pages = options["path"], options.get("rows") == "pages"
        self.asked = [Segment(i, s, date.fromisoformat(a), date.fromisoformat(b)) for i, s, a, b in json.loads(options["segments"])]
        self.provider = options.get("provider", "bars")
        self.symbols: set[str] | None = None
        self.first, self.last = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols and bounds of days are taken here; all filters stay with Spark too, since pages hold whole stretches of days."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("symbol",) and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = given if self.symbols is None else self.symbols & given
            if column == ("session_date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value)
            if column == ("session_date",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[Segment]:
        found = [s for s in self.asked if (self.symbols is None or s.symbol in self.symbols) and s.first <= self.last and s.last >= self.first]
        return found or [Segment("", "", date.max, date.min)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        if not partition.symbol:
            return
        held, token, seen = Collection(self.root, partition.collection), None, set()
        by_day: dict[date, tuple] = {}
        for page in range(MOST_PAGES + 1):
            if page == MOST_PAGES:
                raise ValueError(f"{partition.symbol}: over {MOST_PAGES} pages")
            manifest, content = held.get(token or "")
            native = f"{self.provider}:{partition.listing_id}:{manifest['parameters']}"
            observation = str(uuid.uuid5(uuid.NAMESPACE_OID, canonical_json([self.provider, native, manifest["content_sha256"]]).decode()))
            bars, token = parsed_page(content, partition)
            if self.pages:
                yield partition.listing_id, partition.symbol, page, len(bars), observation, native, manifest["content_sha256"], manifest["retrieved_at"]
            for day, *values in bars:
                if by_day.setdefault(day, (*values, page, observation))[:5] != tuple(values):
                    raise ConflictError(f"{partition.symbol}: two bars for {day}")
            if token is None:
                break
            if token in seen:
                raise ValueError(f"{partition.symbol}: a token comes again")
            seen.add(token)
        if not self.pages:
            yield from ((partition.listing_id, partition.symbol, day, *values) for day, values in sorted(by_day.items()))


def parsed_page(content: bytes, segment: Segment) -> tuple[list[tuple], str | None]:
    """The bars of a page, with exact decimals, and the token of the next page; what a page must not hold raises."""
    try:
        body = json.loads(content, parse_float=Decimal, parse_constant=lambda x: Decimal("nan"))
        by_symbol, token = body["bars"], body.get("next_page_token")
        if set(by_symbol) - {segment.symbol} or not (token is None or isinstance(token, str) and token):
            raise ValueError("another symbol, or a token that is none")
        bars = [exact_bar(b) for b in by_symbol.get(segment.symbol, [])]
    except (KeyError, TypeError, AttributeError, ValueError, InvalidOperation) as broken:
        raise ValueError(f"{segment.symbol}: no page of bars") from broken
    outside = [day for day, *_ in bars if not segment.first <= day <= segment.last]
    if outside:
        raise ValueError(f"{segment.symbol}: a bar of {outside[0]} outside of what was asked for")
    return bars, token


def exact_bar(bar: dict) -> tuple:
    """(day, open, high, low, close, volume); the stamp must be midnight in New York, numbers finite and no booleans."""
    at = datetime.fromisoformat(bar["t"].replace("Z", "+00:00")).astimezone(NEW_YORK)
    numbers = [bar[k] for k in "ohlc"] + [bar.get("v")]
    if (at.hour, at.minute, at.second, at.microsecond) != (0, 0, 0, 0) or any(isinstance(x, (bool, str)) or x is None for x in numbers[:4]) or isinstance(numbers[4], (bool, str)):
        raise ValueError("no daily bar")
    prices = [Decimal(x) for x in numbers[:4]]
    volume = None if numbers[4] is None else Decimal(numbers[4])
    if not all(p.is_finite() for p in prices) or volume is not None and volume != volume.to_integral_value():
        raise ValueError("no finite price or no whole volume")
    return at.date(), *prices, None if volume is None else int(volume)


class PagedBars(DataSource):
    """``read.format("paged_bars")``: bars, or with rows=pages their pages, of segments whose pages were captured."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return PAGES if self.options.get("rows") == "pages" else BARS

    def reader(self, schema) -> PagedBarsReader:
        return PagedBarsReader(dict(self.options))


def paged(spark: SparkSession, root: str, asked: list[Segment], rows: str = "bars", provider: str = "bars") -> DataFrame:
    """Bars or pages of the segments; each segment is a task of its own, and filters on symbol and day leave segments out."""
    ship(spark)
    spark.dataSource.register(PagedBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    stated = json.dumps([[s.listing_id, s.symbol, str(s.first), str(s.last)] for s in asked])
    return spark.read.format("paged_bars").option("segments", stated).option("rows", rows).option("provider", provider).load(root)


def listing_bars(bars: DataFrame) -> DataFrame:
    """One bar for each listing and session: equal ones of several symbols collapse, others raise when read."""
    values = F.struct("open", "high", "low", "close", "volume")
    found = bars.groupBy("listing_id", "session_date").agg(F.min(F.struct(values.alias("v"), "symbol", "page", "observation_id")).alias("b"), F.max(values).alias("other"))
    found = require(found, F.col("b.v") == F.col("other"), "conflicting bars for a listing's session")
    return found.select("listing_id", "session_date", "b.symbol", "b.v.*", "b.page", "b.observation_id")


def bar_bodies(bars: DataFrame, size: int) -> DataFrame:
    """(collection, name, content, parameters) of (symbol, first, last, session_date, open, high, low, close, volume): pages of ``size`` bars, chained by token."""
    from pyspark.sql import Window

    keys = ["symbol", "first", "last"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("session_date")) - 1
    stamp = F.date_format(F.to_utc_timestamp(F.col("session_date").cast("timestamp"), "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bar = F.struct(stamp.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    pages = bars.withColumn("page", F.floor(place / size).cast("int")).groupBy(*keys, "page").agg(F.array_sort(F.collect_list(bar)).alias("rows"))
    last = F.max("page").over(Window.partitionBy(*keys))
    token = lambda page: F.sha2(F.concat_ws("/", *keys, page), 256)
    following = F.when(F.col("page") < last, token(F.col("page") + 1))
    body = F.to_json(F.struct(F.create_map("symbol", "rows").alias("bars"), following.alias("next_page_token")), {"ignoreNullFields": "false"})
    name = F.when(F.col("page") == 0, "").otherwise(token(F.col("page")))
    return pages.select(F.concat_ws("_", *keys).alias("collection"), name.alias("name"), F.encode(body, "UTF-8").alias("content"), F.to_json(F.struct(*keys, name.alias("cursor"))).alias("parameters")).repartition("collection")
