"""Helpers shared by the operators: registration, written intermediates, column names."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ASCII white space as the result contracts define it.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    """Register a query over the test tables; `sql` gives the same rows in plain SQL."""

    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write the rows once below spark.checkpoint.dir and read them back; cuts the lineage."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of the frame, whatever it carries along."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a variable, so that it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def short_batches(docs: DataFrame, most: int = 1000) -> None:
    """Send whole texts to Python at most `most` at a time, so that long ones fit a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= most:
        conf.set(name, str(most))


def worker_state(name: str, make: Callable[[], object]):
    """An object that a Python worker keeps from task to task (caches, loaded vocabularies)."""
    holder = sys.modules.setdefault("millrace_worker_state", types.ModuleType("millrace_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def held_out(doc_id: str, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    part = F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(of)
    return F.coalesce(part == remainder, F.lit(False))
