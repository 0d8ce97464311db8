"""Current state of jobs and steps kept by a stream, so that questions need no fold of the whole log.

The newest value of every field is a streaming aggregate in the state store; in update mode a micro-batch gives
the new state of the records that its patches touch and reads nothing else. Metadata entries are an
aggregate of their own, since they merge one by one. Each batch's states go to its own partition of a plain
catalog table, which a replay overwrites; the current state of a record is its newest row there, and
`settle` leaves those alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.folding import latest
from millrace.sources.messages import pace

ORDER = ("patched_at", "seq")
#: The partition that settled rows go to; batches count from 0.
SETTLED = -1


def field_states(patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The newest value of each field per record, and whether it was created."""
    created = F.max(F.col("op") == "create").alias("created")
    return patches.groupBy(key).agg(*[latest(f, ORDER) for f in fields], created)


def entry_states(patches: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """The newest value of each map entry per record."""
    entries = patches.select(key, *ORDER, F.explode(column).alias("entry_key", "entry_value"))
    return entries.groupBy(key, "entry_key").agg(F.max_by("entry_value", F.struct(*ORDER)).alias("entry_value"))


def keep(states: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the changed states of each micro-batch to `table`, partitioned by `batch`."""
    spark = states.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], states.schema).withColumn("batch", F.lit(0).cast("long"))
        empty.write.format("parquet").partitionBy("batch").saveAsTable(table)

    def store(changed: DataFrame, number: int) -> None:
        _overwrite(changed, table, number)

    return (
        states.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**pace(every)).start()
    )


def _overwrite(rows: DataFrame, table: str, number: int) -> None:
    """Replace one partition by the rows."""
    spark = rows.sparkSession
    names = [f"`{c}`" for c in spark.table(table).columns if c != "batch"]
    spark.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {number}) SELECT {', '.join(names)} FROM {{rows}}", rows=rows
    )


def newest(spark: SparkSession, table: str, key: Sequence[str]) -> DataFrame:
    """The newest row of each key in a state table, reduced before the shuffle."""
    rows = spark.table(table)
    others = F.struct(*[c for c in rows.columns if c not in key and c != "batch"])
    found = rows.groupBy(*key).agg(F.max_by(others, "batch").alias("state"))
    return found.select(*key, "state.*")


def current(spark: SparkSession, fields_table: str, entries_table: str, key: str, column: str = "metadata") -> DataFrame:
    """One row per created record, as the fold of its whole log gives it."""
    state = newest(spark, fields_table, [key]).filter("created").drop("created")
    entries = newest(spark, entries_table, [key, "entry_key"]).groupBy(key)
    merged = entries.agg(F.map_from_entries(F.collect_list(F.struct("entry_key", "entry_value"))).alias(column))
    empty = F.create_map().cast("map<string,string>")
    return state.join(merged, key, "left").withColumn(column, F.coalesce(column, empty))


def settle(spark: SparkSession, table: str, key: Sequence[str], scratch_path: str) -> None:
    """Leave one row per key in a state table. Run it while its stream is stopped; a call that dies can be repeated.

    The settled rows are older than those of any batch, so that replacing them first and dropping the
    batches they hold afterwards never shows a wrong state.
    """
    batches = [r["batch"] for r in spark.table(table).select("batch").distinct().collect() if r["batch"] != SETTLED]
    newest(spark, table, key).write.mode("overwrite").parquet(scratch_path)
    settled = spark.read.schema(spark.table(table).drop("batch").schema).parquet(scratch_path)
    _overwrite(settled, table, SETTLED)
    for number in batches:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (batch = {number})")
