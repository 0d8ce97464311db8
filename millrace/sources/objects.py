"""Stored objects as rows: listing, bodies and metadata, whatever their size and name.

A Python data source lists prefixes in parallel tasks: the driver only walks folders, level by level, until
there are `SPREAD` of them. Unlike Spark's file sources it sees empty objects and names that begin
with `_` or `.`. Metadata of given objects is asked for path by path and needs no listing. Bodies are
read by the tasks, a few at a time. Stores that pyarrow has no client for are read by Spark's
binaryFile source, which passes over empty and hidden objects. A body is one value of one row, at most 2 GiB.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources import storage

#: Folders after which the driver stops walking and leaves what is below them to the tasks.
SPREAD = 64
#: Bytes of bodies that a task hands on at a time.
CHUNK = 32 << 20
# Schemes that pyarrow opens, and the names that it has for them.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}


def _scheme(root: str) -> str:
    return root.split(":", 1)[0] if ":" in root.split("/", 1)[0] else "file"


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """The client of a store and the root's path there; local paths are taken letter by letter."""
    scheme = _scheme(root)
    if scheme == "file":
        path = root.split(":", 1)[1] if root.startswith("file:") else root
        return fs.LocalFileSystem(), "/" + path.strip("/")
    store, path = fs.FileSystem.from_uri(SCHEMES[scheme] + root[len(scheme) :])
    return store, path.rstrip("/")


@dataclass
class Prefix(InputPartition):
    """What one task lists: the files of a folder whose names begin with `start`, or all below it."""

    folder: str
    start: str
    below: bool


class ObjectReader(DataSourceReader):
    def __init__(self, root: str, prefix: str, spread: int) -> None:
        self.root, self.prefix, self.spread = root, prefix, spread

    def partitions(self) -> list[Prefix]:
        store, root = open_store(self.root)
        inner, start = posixpath.split(self.prefix)
        place = f"{root}/{inner}" if inner else root
        found, waiting = [Prefix(place, start, False)], self._folders(store, place, start)
        while waiting and len(found) + len(waiting) < self.spread:
            folder = waiting.pop(0)
            found.append(Prefix(folder, "", False))
            waiting += self._folders(store, folder, "")
        return found + [Prefix(folder, "", True) for folder in waiting]

    @staticmethod
    def _folders(store: fs.FileSystem, place: str, start: str) -> list[str]:
        infos = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
        return sorted(x.path for x in infos if x.type == fs.FileType.Directory and x.base_name.startswith(start))

    def read(self, partition: Prefix) -> Iterator[tuple[str, int, int]]:
        store, root = open_store(self.root)
        select = fs.FileSelector(partition.folder, allow_not_found=True, recursive=partition.below)
        for x in store.get_file_info(select):
            if x.type == fs.FileType.File and (partition.below or x.base_name.startswith(partition.start)):
                yield x.path[len(root) + 1 :], x.size, x.mtime_ns // 1000


class ObjectSource(DataSource):
    """`key, size, modified_us` of all objects below the option `root` whose key begins with `prefix`."""

    @classmethod
    def name(cls) -> str:
        return "stored_objects"

    def schema(self) -> str:
        return "key string, size long, modified_us long"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["root"], self.options.get("prefix", ""), int(self.options.get("spread", SPREAD)))


def _known(spark: SparkSession, root: str, prefix: str | None, spread: int = SPREAD) -> DataFrame:
    """`key, size, modified_us` of the objects below root whose key begins with the prefix."""
    base = storage.qualified(spark, root)
    if _scheme(base) in SCHEMES:
        spark.dataSource.register(ObjectSource)
        source = spark.read.format("stored_objects").option("root", base).option("spread", spread)
        return source.option("prefix", prefix or "").load()
    files = _files(spark, base, prefix)
    return files.select("key", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"))


def _files(spark: SparkSession, base: str, prefix: str | None) -> DataFrame:
    """Files below base from Spark's file index, with `key` as the path relative to it."""
    place = base
    if prefix:
        place = f"{storage.literal(base)}/{storage.literal(prefix)}*"
        if not storage.matches_any(spark, place):
            return spark.createDataFrame([], _NO_FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place)
    return files.withColumn("key", F.substr("path", F.lit(len(base) + 2)))


_NO_FILES = "path string, modificationTime timestamp, length bigint, content binary, key string"


def _shown(rows: DataFrame, key: str = "key") -> list[Column]:
    """Size, etag and time; an etag changes whenever the object is rewritten and needs no read of the body."""
    etag = F.md5(F.concat_ws("|", key, F.col("size").cast("string"), F.col("modified_us").cast("string")))
    return [
        F.col("size"),
        F.when(F.col("size").isNotNull(), etag).alias("etag"),
        F.timestamp_micros("modified_us").alias("last_modified"),
    ]


def list_objects(spark: SparkSession, root: str, prefix: str | None = None, spread: int = SPREAD) -> DataFrame:
    """Every object under the prefix: `path, size, etag, last_modified`; bodies are not read.

    A root that does not exist has no objects.
    """
    known = _known(spark, root, prefix, spread)
    return known.select(F.col("key").alias("path"), *_shown(known))


@dataclass(frozen=True)
class ListingPage:
    objects: list[Row]
    count: int
    is_truncated: bool
    next_start: str | None


def list_page(
    spark: SparkSession,
    root: str,
    prefix: str | None = None,
    max_keys: int = 1000,
    start_after: str | None = None,
) -> ListingPage:
    """One page of the listing in path order, with the path to continue after."""
    listing = list_objects(spark, root, prefix)
    if start_after is not None:
        listing = listing.filter(F.col("path") > start_after)
    rows = listing.orderBy("path").limit(max_keys + 1).collect()
    page, more = rows[:max_keys], len(rows) > max_keys
    return ListingPage(page, len(page), more, page[-1].path if more and page else None)


def scan_objects(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """Object bodies, raw and as base64 text, with their size: `path, body, body_base64, size, last_modified`.

    Keys are dealt out again after the listing, so a folder of many objects is read by many tasks. An object
    that goes between listing and reading is an error.
    """
    base = storage.qualified(spark, root)
    if _scheme(base) in SCHEMES:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = _known(spark, root, prefix).repartition(tasks, "key")
        read = known.mapInArrow(_reader(base), "key string, content binary, length long, modified_us long")
        read = read.withColumn("modificationTime", F.timestamp_micros("modified_us"))
    else:
        read = _files(spark, base, prefix)
    return read.select(
        F.col("key").alias("path"),
        F.col("content").alias("body"),
        F.base64("content").alias("body_base64"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )


def _reader(base: str):
    """Rows of keys with their bodies, in batches of at most `CHUNK` bytes or one body."""

    def batch(rows: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
        keys, bodies, times = zip(*rows, strict=True)
        columns = [pa.array(keys, pa.string()), pa.array(bodies, pa.binary()), pa.array(map(len, bodies), pa.int64())]
        names = ["key", "content", "length", "modified_us"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(times, pa.int64())], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(base)
        held, size = [], 0
        for given in batches:
            for key, time in zip(given.column("key").to_pylist(), given.column("modified_us").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{key}") as file:
                    body = file.read()
                if held and size + len(body) > CHUNK:
                    yield batch(held)
                    held, size = [], 0
                held.append((key, body, time))
                size += len(body)
        if held:
            yield batch(held)

    return read


def stat_objects(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """`wanted(path, …)` with `size, etag, last_modified` and `found`, which is false where there is no such object.

    Each task asks for the paths of its own rows; nothing is listed. A path that is null, empty, a folder or
    not in its plain form (`a//b`, `../a`) names no object.
    """
    base = storage.qualified(spark, root)
    clash = {"size", "etag", "last_modified", "found", "modified_us"} & {c.lower() for c in wanted.columns}
    if clash:
        raise ValueError(f"wanted already has the columns {sorted(clash)}")
    if _scheme(base) in SCHEMES:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
        known = wanted.mapInArrow(_asker(base), f"{kinds}, size long, modified_us long")
    else:
        known = wanted.join(_known(spark, root, None).withColumnRenamed("key", "path"), "path", "left")
    others = [F.col(f"`{c}`") for c in wanted.columns]
    return known.select(*others, *_shown(known, "path"), F.col("size").isNotNull().alias("found"))


def _asker(base: str):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(base)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            plain = [p for p in dict.fromkeys(paths) if p and posixpath.normpath(p) == p and not p.startswith(("/", ".."))]
            infos = store.get_file_info([f"{root}/{p}" for p in plain])
            known = {p: x for p, x in zip(plain, infos, strict=True) if x.type == fs.FileType.File}
            sizes = [known[p].size if p in known else None for p in paths]
            times = [known[p].mtime_ns // 1000 if p in known else None for p in paths]
            added = [pa.array(sizes, pa.int64()), pa.array(times, pa.int64())]
            names = [*batch.schema.names, "size", "modified_us"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return ask
