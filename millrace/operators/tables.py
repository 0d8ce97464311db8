"""Catalogue tables with keys: create, insert, upsert, truncate, inspect.

Parquet tables keep neither keys nor NOT NULL, so both live in the table properties and are
checked before each write. Replaced data is written to a new folder first and becomes visible
by pointing the table (or the touched buckets) at it, so a job that dies half-way leaves the old
rows in place and can simply be run again.

A keyed table may be created with `buckets`: rows are then laid out by a hash of the key, and an
insert or upsert reads and rewrites only the buckets its keys fall into.

Each write leaves a mark of its own in the table properties. A writer that finds another mark than
the one it started from gives up (`ConflictError`) instead of writing over rows it has not seen.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from millrace.functions.types import spark_type
from millrace.operators.checks import null_counts
from millrace.sources import storage

DEFAULT_DATABASE = "main"
BUCKET = "key_bucket"
SPEC = "millrace.spec"
MARK = "millrace.mark"

Rows = DataFrame | Sequence[Mapping[str, Any]]


class ConstraintError(ValueError):
    """Rows break a key or NOT NULL rule; nothing was written."""


class ConflictError(RuntimeError):
    """Another writer changed the table meanwhile; nothing was written, and the call can be repeated."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str
    nullable: bool = True
    primary_key: bool = False


@dataclass(frozen=True)
class TableInfo:
    name: str
    database: str
    columns: list[dict[str, Any]]
    row_count: int


@dataclass(frozen=True)
class _Spec:
    keys: list[str]
    required: list[str]
    buckets: int


def qualified(name: str) -> str:
    """`database.table`; a bare name lives in the default database."""
    return name if "." in name else f"{DEFAULT_DATABASE}.{name}"


def create_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[ColumnSpec],
    if_not_exists: bool = True,
    buckets: int = 0,
) -> None:
    """Create a table; an existing one is kept as it is unless `if_not_exists` is false."""
    table = qualified(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.', 1)[0]}")
    keys = [c.name for c in columns if c.primary_key]
    required = [c.name for c in columns if c.primary_key or not c.nullable]
    if buckets and not keys:
        raise ValueError("buckets need a primary key")
    parts = [f"`{c.name}` {spark_type(c.dtype)}" for c in columns]
    partitions = ""
    if buckets:
        parts.append(f"{BUCKET} int")
        partitions = f"PARTITIONED BY ({BUCKET})"
    spec = json.dumps({"keys": keys, "required": required, "buckets": buckets}).replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{table} ({', '.join(parts)}) "
        f"USING parquet {partitions} TBLPROPERTIES ('{SPEC}' = '{spec}')"
    )


def _spec(spark: SparkSession, table: str) -> _Spec:
    found = json.loads(_property(spark, table, SPEC) or "{}")
    return _Spec(found.get("keys", []), found.get("required", []), found.get("buckets", 0))


def _property(spark: SparkSession, table: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == key).collect()
    return rows[0].value if rows else None


def _claim(spark: SparkSession, table: str, mark: str | None) -> None:
    """Leave a new mark if the table still has the given one. The metastore cannot compare and set in
    one step, so two writers that come within that moment of each other are not told apart."""
    if _property(spark, table, MARK) != mark:
        raise ConflictError(f"{table} was changed by another writer")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{MARK}' = '{uuid.uuid4().hex}')")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The table's own columns, without the layout column."""
    return spark.table(qualified(name)).drop(BUCKET)


def drop_table(spark: SparkSession, name: str, if_exists: bool = True) -> None:
    """Drop the table and every data folder it was pointed at."""
    table = qualified(name)
    exists = spark.catalog.tableExists(table)
    versions = _versions_folder(spark, table) if exists else None
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{table}")
    if versions:
        storage.delete(spark, versions)


def truncate(spark: SparkSession, name: str) -> None:
    """Remove all rows and keep the schema."""
    table = qualified(name)
    _claim(spark, table, _property(spark, table, MARK))
    spark.sql(f"TRUNCATE TABLE {table}")


def list_tables(spark: SparkSession, database: str = DEFAULT_DATABASE) -> DataFrame:
    """Names of the database's tables in order; temporary views are left out."""
    if not spark.catalog.databaseExists(database):
        return spark.createDataFrame([], "name string")
    return (
        spark.sql(f"SHOW TABLES IN {database}")
        .filter(~F.col("isTemporary"))
        .select(F.col("tableName").alias("name"))
        .orderBy("name")
    )


def table_info(spark: SparkSession, name: str) -> TableInfo | None:
    """Columns in order with their row count, or None for an unknown table."""
    table = qualified(name)
    if not spark.catalog.tableExists(table):
        return None
    database, bare = table.split(".", 1)
    spec = _spec(spark, table)
    frame = read_table(spark, table)
    columns = [
        {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.name not in spec.required}
        for f in frame.schema
    ]
    return TableInfo(bare, database, columns, frame.count())


def insert(spark: SparkSession, name: str, rows: Rows) -> int:
    """Append rows, all or none. A repeated or existing key or a missing required value is an error.

    The rows are written once next to the table, and checked and inserted from there: what was checked
    is what is stored, also where the DataFrame gives other rows each time it is computed.
    """
    table = qualified(name)
    spec = _spec(spark, table)
    mark = _property(spark, table, MARK)
    schema = read_table(spark, table).schema
    batch = _aligned(spark, rows, schema)
    if batch is None:
        return 0
    folder = _new_folder(spark, table)
    try:
        batch = batch.drop("_seq")
        batch.write.parquet(folder)
        batch = spark.read.schema(batch.schema).parquet(folder)
        found = _check_batch(batch, spec)
        if spec.keys:
            _check_new_keys(spark, table, batch, spec, found)
        _claim(spark, table, mark)
        _with_bucket(_with_missing_columns(batch, schema), spec).write.insertInto(table)
    finally:
        storage.delete(spark, folder)
    return found.rows


def upsert(
    spark: SparkSession, name: str, rows: Rows, key_columns: Sequence[str], sequence: str | None = None
) -> int:
    """Insert rows or update the ones whose key exists; returns the number of rows given.

    The last of several rows with one key wins: by list order, or by the `sequence` column of a
    DataFrame, where equal sequence numbers are settled by the row's content. Columns the rows do not
    have keep their old value; an explicit null overwrites.
    """
    if not key_columns:
        raise ValueError("Missing required field: key_columns")
    keys = list(key_columns)
    table = qualified(name)
    spec = _spec(spark, table)
    if spec.keys and sorted(keys) != sorted(spec.keys):
        raise ValueError(f"the table's key is {spec.keys}, not {keys}")
    mark = _property(spark, table, MARK)
    batch = _aligned(spark, rows, read_table(spark, table).schema, sequence)
    if batch is None:
        return 0
    staged = _stage(spark, table, batch, keys, spec)
    try:
        if spec.buckets:
            _merge_buckets(spark, table, staged, spec, mark)
        else:
            _merge_whole(spark, table, staged, keys, spec, mark)
    finally:
        storage.delete(spark, staged.folder)
    return staged.given


@dataclass(frozen=True)
class _Staged:
    """One row per key, written out once, with what was counted while writing."""

    folder: str
    rows: DataFrame
    given: int
    size: int
    limit: int

    @property
    def small(self) -> bool:
        return self.size <= self.limit


def _stage(
    spark: SparkSession, table: str, batch: DataFrame, keys: Sequence[str], spec: _Spec
) -> _Staged:
    """Write the last row per key next to the table: the merge reads it more than once, and a lost
    executor takes none of it away. The same job checks nulls and measures the size."""
    missing = [c for c in keys if c not in batch.columns]
    if missing:
        raise ConstraintError(f"key columns missing: {', '.join(missing)}")
    checked = [c for c in spec.required if c in batch.columns and c not in keys]
    had_null = [F.max(F.col(c).isNull()).alias(f"_null_{c}") for c in checked]
    last = latest_rows(batch, keys, extra=[F.count("*").alias("_given"), *had_null])
    plain = [c for c in batch.columns if c != "_seq"]
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in keys]
    nulls += [F.count_if(f"_null_{c}").alias(c) for c in checked]
    seen = Observation()
    folder = _new_folder(spark, table)
    (
        last.withColumn("_bytes", _byte_size(last.select(*plain)))
        .observe(
            seen,
            F.coalesce(F.sum("_given"), F.lit(0)).alias("_given"),
            F.coalesce(F.sum("_bytes"), F.lit(0)).alias("_size"),
            *nulls,
        )
        .select(*plain)
        .write.parquet(folder)
    )
    counts = dict(seen.get)
    given, size = counts.pop("_given"), counts.pop("_size")
    try:
        _refuse_nulls(counts)
    except ConstraintError:
        storage.delete(spark, folder)
        raise
    schema = last.select(*plain).schema
    limit = storage.broadcast_limit(spark)
    return _Staged(folder, spark.read.schema(schema).parquet(folder), given, size, limit)


def latest_rows(
    batch: DataFrame, keys: Sequence[str], sequence: str = "_seq", extra: Sequence[Column] = ()
) -> DataFrame:
    """The last row per key. A grouped maximum, so a key that fills the batch still combines early.

    Maps have no order; where sequence numbers are equal, their JSON text decides with the other values.
    """
    values = [c for c in batch.columns if c not in (*keys, sequence)]
    unordered = [f.name for f in batch.schema if f.name in values and "map<" in f.dataType.simpleString()]
    if unordered:
        order = [F.to_json(F.struct(c)) if c in unordered else F.col(c) for c in values]
        newest = F.max_by(F.struct(sequence, *values), F.struct(sequence, *order)).alias("_row")
    else:
        newest = F.max(F.struct(sequence, *values)).alias("_row")
    grouped = batch.groupBy(*keys).agg(newest, *extra)
    rest = [c for c in grouped.columns if c not in (*keys, "_row")]
    return grouped.select(*keys, *[F.col(f"_row.{c}") for c in values], *rest)


def merge(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], small_batch: bool = False
) -> DataFrame:
    """The target with the batch (one row per key) laid over it.

    With a batch known to be small the target is not shuffled: its rows look the batch up by
    broadcast, and the keys they have in common, at most the batch's, tell which rows are new.
    Otherwise one full outer join does both.
    """
    keys = list(keys)
    columns = target.columns
    given = [c for c in batch.columns if c not in keys]
    renamed = batch.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in given]
    )

    def overlaid(joined: DataFrame) -> DataFrame:
        picked = [
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in given
            else F.col(c)
            for c in columns
        ]
        return joined.select(*picked)

    if not small_batch:
        return overlaid(target.join(renamed, keys, "full_outer"))
    kept = overlaid(target.join(F.broadcast(renamed), keys, "left"))
    common = target.join(F.broadcast(batch.select(*keys)), keys, "left_semi").select(*keys).distinct()
    fresh = _with_missing_columns(batch.join(common, keys, "left_anti"), target.schema)
    return kept.unionByName(fresh)


def store(spark: SparkSession, name: str, frame: DataFrame) -> DataFrame:
    """Make the frame the table's content, whatever it held before.

    The rows go to a new folder; the table is pointed at it once they are all written. A table with
    declared rules keeps them: rows that break one or have other columns are refused, and the table
    stays as it was. A bucketed table takes rows by `insert` and `upsert` alone.
    """
    table = qualified(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.', 1)[0]}")
    kept = spark.catalog.tableExists(table)
    spec = _spec(spark, table) if kept else _Spec([], [], 0)
    mark = _property(spark, table, MARK) if kept else None
    if spec.buckets:
        raise ValueError(f"{table} has buckets: truncate it and insert")
    ruled = bool(spec.keys or spec.required)
    if ruled and layout(spark.table(table)) != layout(frame):
        raise ValueError(f"{table} has declared rules and other columns: drop it first")
    folder = _new_folder(spark, table)
    frame.write.parquet(folder)
    columns = ", ".join(f"`{name}` {kind}" for name, kind in layout(frame))
    if ruled:
        try:
            _check_batch(spark.read.schema(frame.schema).parquet(folder), spec)
        except ConstraintError:
            storage.delete(spark, folder)
            raise
    if kept:
        _claim_for(spark, table, mark, folder)
    if kept and layout(spark.table(table)) == layout(frame):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{folder}'")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def layout(frame: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, nullability apart."""
    return [(f.name, f.dataType.simpleString()) for f in frame.schema]


def prune_versions(spark: SparkSession, name: str) -> list[str]:
    """Delete data folders the table no longer points at; run it when no reader uses them and nobody writes."""
    table = qualified(name)
    used = {_location(spark, table)} | set(_partition_locations(spark, table).values())
    gone = []
    for folder in storage.children(spark, _versions_folder(spark, table)):
        if not any(u.startswith(folder) for u in used):
            storage.delete(spark, folder)
            gone.append(folder)
    return gone


# --- batches ---------------------------------------------------------------------------------


def _aligned(
    spark: SparkSession, rows: Rows, schema: StructType, sequence: str | None = None
) -> DataFrame | None:
    """The batch under the table's types, with its order in `_seq`; None for an empty list."""
    if isinstance(rows, DataFrame):
        batch = rows
        names = [c for c in rows.columns if c != sequence]
        order = F.col(sequence) if sequence else F.lit(0)
    else:
        if not rows:
            return None
        names = list(rows[0])
        data = [(i, *[_text(row[n]) for n in names]) for i, row in enumerate(rows)]
        types = [
            "binary" if n in schema.names and isinstance(schema[n].dataType, BinaryType) else "string"
            for n in names
        ]
        ddl = ", ".join(["_seq bigint", *[f"`{n}` {t}" for n, t in zip(names, types, strict=True)]])
        batch, order = spark.createDataFrame(data, ddl), F.col("_seq")
        nested = [n for n in names if n in schema.names and isinstance(schema[n].dataType, ArrayType | MapType | StructType)]
        batch = batch.withColumns({n: F.from_json(n, schema[n].dataType, {"mode": "FAILFAST"}) for n in nested})
    unknown = [n for n in names if n not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return batch.select(order.alias("_seq"), *[F.col(n).cast(schema[n].dataType).alias(n) for n in names])


def _text(value: Any) -> Any:
    if value is None or isinstance(value, bytes | bytearray):
        return value
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, Mapping | list | tuple):
        return json.dumps(value, default=_text)
    return str(value)


def _with_missing_columns(batch: DataFrame, schema: StructType) -> DataFrame:
    return batch.select(
        *[
            F.col(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _bucket(spec: _Spec) -> Column:
    return F.pmod(F.hash(*spec.keys), F.lit(spec.buckets)).cast("int").alias(BUCKET)


def _with_bucket(frame: DataFrame, spec: _Spec) -> DataFrame:
    """Adds the layout column and gathers each bucket into few, evenly sized files."""
    if not spec.buckets:
        return frame
    return frame.select("*", _bucket(spec)).hint("rebalance", BUCKET)


# --- rules -----------------------------------------------------------------------------------


def _byte_size(frame: DataFrame) -> Column:
    """Bytes a row takes: text and nested values measured, the rest counted as 16."""
    size = F.lit(0)
    for field in frame.schema:
        if isinstance(field.dataType, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, ArrayType | MapType | StructType):
            size = size + F.coalesce(F.length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            size = size + 16
    return size


@dataclass(frozen=True)
class _Checked:
    rows: int
    touched: list[int]


def _check_batch(batch: DataFrame, spec: _Spec) -> _Checked:
    """Nulls, repeated keys, row count and touched buckets of a batch, in one job."""
    absent = [c for c in spec.required if c not in batch.columns]
    if absent:
        raise ConstraintError(f"NOT NULL columns missing: {', '.join(absent)}")
    if not spec.keys:
        counts = null_counts(batch, spec.required).first().asDict()
        rows = counts.pop("row_count")
        _refuse_nulls(counts)
        return _Checked(rows, [])
    others = [c for c in spec.required if c not in spec.keys]
    per_key = batch.groupBy(*spec.keys).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in others]
    )
    found = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        F.max(F.when(F.col("_n") > 1, F.struct(*spec.keys))).alias("_repeated"),
        (F.collect_set(_bucket(spec)) if spec.buckets else F.array()).alias("_touched"),
        *[F.sum(F.when(F.col(c).isNull(), F.col("_n"))).alias(c) for c in spec.keys],
        *[F.sum(f"_null_{c}").alias(c) for c in others],
    ).first()
    _refuse_nulls({c: found[c] for c in spec.required})
    if found["_repeated"]:
        raise ConstraintError(f"duplicate key in the rows: {found['_repeated'].asDict()}")
    return _Checked(found["_rows"], sorted(found["_touched"]))


def _refuse_nulls(counts: Mapping[str, int]) -> None:
    broken = {c: n for c, n in counts.items() if n}
    if broken:
        raise ConstraintError(f"NOT NULL violated, null rows per column: {broken}")


def _check_new_keys(
    spark: SparkSession, table: str, batch: DataFrame, spec: _Spec, found: _Checked
) -> None:
    """No key that the table already has; only the buckets the batch falls into are read."""
    target = spark.table(table)
    if spec.buckets:
        target = target.filter(F.col(BUCKET).isin(found.touched))
    taken = batch.select(*spec.keys).join(target.select(*spec.keys), spec.keys, "left_semi").limit(1).collect()
    if taken:
        raise ConstraintError(f"duplicate key in the table: {taken[0].asDict()}")


# --- replacing data --------------------------------------------------------------------------


def _touched(batch: DataFrame, spec: _Spec) -> list[int]:
    """Buckets the batch falls into; at most as many as the table has."""
    return sorted(r[0] for r in batch.select(_bucket(spec)).distinct().collect())


def _merge_buckets(
    spark: SparkSession, table: str, staged: _Staged, spec: _Spec, mark: str | None
) -> None:
    """Merge within the touched buckets, then point each of them at its new folder."""
    touched = _touched(staged.rows, spec)
    target = spark.table(table).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    merged = merge(target, staged.rows, spec.keys, staged.small)
    folder = _write_version(spark, table, _with_bucket(merged, spec), spec)
    _claim_for(spark, table, mark, folder)
    known = {int(row[0].split("=")[1]) for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    for bucket in touched:
        part, place = f"PARTITION ({BUCKET} = {bucket})", f"'{folder}/{BUCKET}={bucket}'"
        if bucket in known:
            spark.sql(f"ALTER TABLE {table} {part} SET LOCATION {place}")
        else:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {part} LOCATION {place}")
    spark.catalog.refreshTable(table)


def _merge_whole(
    spark: SparkSession, table: str, staged: _Staged, keys: Sequence[str], spec: _Spec, mark: str | None
) -> None:
    merged = merge(spark.table(table), staged.rows, keys, staged.small)
    folder = _write_version(spark, table, merged, spec)
    _claim_for(spark, table, mark, folder)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(table)


def _write_version(spark: SparkSession, table: str, merged: DataFrame, spec: _Spec) -> str:
    """Write to a new folder, counting nulls on the way; a broken rule leaves the table as it was."""
    folder = _new_folder(spark, table)
    seen = Observation()
    if spec.required:
        merged = merged.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in spec.required])
    writer = merged.write.partitionBy(BUCKET) if spec.buckets else merged.write
    writer.parquet(folder)
    if spec.required:
        try:
            _refuse_nulls(seen.get)
        except ConstraintError:
            storage.delete(spark, folder)
            raise
    return folder


def _claim_for(spark: SparkSession, table: str, mark: str | None, folder: str) -> None:
    """Claim the table for the rows in the folder, which goes if another writer was first."""
    try:
        _claim(spark, table, mark)
    except ConflictError:
        storage.delete(spark, folder)
        raise


def _new_folder(spark: SparkSession, table: str) -> str:
    return f"{_versions_folder(spark, table)}/{uuid.uuid4().hex[:12]}"


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").collect()
    return rows[0].data_type


def _versions_folder(spark: SparkSession, table: str) -> str:
    database, bare = table.split(".", 1)
    rows = spark.sql(f"DESCRIBE DATABASE {database}").filter("info_name = 'Location'").collect()
    return f"{rows[0].info_value.rstrip('/')}/{bare}__versions"


def _partition_locations(spark: SparkSession, table: str) -> dict[int, str]:
    if BUCKET not in spark.table(table).columns:
        return {}
    found = {}
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        bucket = int(row[0].split("=")[1])
        detail = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION ({BUCKET} = {bucket})")
        found[bucket] = detail.filter("col_name = 'Location'").first().data_type
    return found
