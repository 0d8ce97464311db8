"""Result messages turned into step patches, and the streaming consumer that stores them."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.session import scratch
from millrace.sources import storage
from millrace.sources.messages import pace
from millrace.streaming.envelope import decode


def _given(column: str) -> Column:
    """The list, or null when it is empty, so that an empty list patches nothing."""
    return F.when(F.size(column) > 0, F.col(column))


def _sequence(results: DataFrame) -> Column:
    """The order of results of one time: by position where the source has one, then by a checksum, so
    that a replay gives the same order."""
    mark = F.crc32(F.col("body").cast("binary"))
    if "position" not in results.columns:
        return mark
    # 41 bits hold offsets and milliseconds, 22 are left for the checksum.
    return F.coalesce(F.shiftleft("position", 22) + F.shiftright(mark, 10), mark)


def step_patches(results: DataFrame) -> DataFrame:
    """Patches for the results that belong to a tracked step.

    Success stays success and anything else is failed; the patch time is the result's own.
    """
    return results.filter(F.col("step_id").isNotNull() & (F.col("step_id") != "")).select(
        "step_id",
        F.when(F.col("status") == "success", "success").otherwise("failed").alias("status"),
        "duration_ms",
        _given("inputs").alias("inputs"),
        _given("outputs").alias("outputs"),
        _given("executions").alias("executions"),
        F.when(F.size("errors") > 0, F.array_join("errors", "; ")).alias("error"),
        F.col("timestamp").alias("completed_at"),
        F.col("timestamp").alias("patched_at"),
        _sequence(results).alias("seq"),
        "correlation_id",
    )


def intake(raw: DataFrame, known_steps: DataFrame | None = None) -> DataFrame:
    """One row per raw message: its outcome and, for an update, the patch.

    Outcomes are `updated`, `skipped` (no step id) and `error` (unreadable, or the step is
    unknown when `known_steps` is given). Nothing is dropped and one bad message stops nothing.
    """
    results = decode(raw, "result")
    tracked = F.coalesce(F.col("step_id") != "", F.lit(False))
    outcome = (
        F.when(~F.col("valid"), "error").when(tracked, "updated").otherwise("skipped")
    )
    reason = F.when(~F.col("valid"), "unreadable message").when(~tracked, "no_step_id")
    rows = results.withColumns({"outcome": outcome, "reason": reason})
    if known_steps is not None:
        updated = F.col("outcome") == "updated"
        # Messages that need no lookup get a key of their own: a shared null key would be one hot task.
        spread = F.crc32(F.col("body").cast("binary")).cast("string")
        known = known_steps.select(
            F.lit(True).alias("lookup"), F.col("step_id").alias("lookup_step")
        ).distinct()
        rows = (
            rows.withColumns(
                {
                    "lookup": updated,
                    "lookup_step": F.when(updated, F.col("step_id")).otherwise(spread),
                }
            )
            .join(known.withColumn("known", F.lit(True)), ["lookup", "lookup_step"], "left")
            .withColumn("missing", updated & F.col("known").isNull())
        )
        not_found = F.concat(F.lit("Step not found: "), "step_id")
        rows = rows.withColumns(
            {
                "reason": F.when(F.col("missing"), not_found).otherwise(F.col("reason")),
                "outcome": F.when(F.col("missing"), "error").otherwise(F.col("outcome")),
            }
        ).drop("known", "missing", "lookup", "lookup_step")
    return rows.drop("valid")


def asked_steps(raw: DataFrame) -> DataFrame:
    """The distinct steps that readable messages belong to."""
    return decode(raw, "result").filter(F.col("valid") & (F.col("step_id") != "")).select("step_id").distinct()


def narrowed(known_steps: DataFrame, asked: DataFrame) -> DataFrame:
    """The known steps that are asked for."""
    return known_steps.select("step_id").join(asked, "step_id", "left_semi")


def consume_results(
    raw: DataFrame,
    folder: str,
    checkpoint: str,
    known_steps: DataFrame | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Store every message of the stream with its outcome: what is there now, or, with an interval
    such as `10 seconds`, what keeps coming.

    `known_steps` is read once per micro-batch and narrowed to the batch's ids before anything is
    shuffled: these are written first, so Spark knows their size and broadcasts them if they are few.
    Without it nothing is looked up, and patches of unknown steps show later in `registry.unknown_patches`.

    Each micro-batch overwrites its own folder, so a replayed batch changes nothing, and one
    write carries patches, skips and rejects as partitions of one table. The folder is named after
    the checkpoint as well: batch numbers start again with a new one.
    """
    stream = "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        place = f"{folder}/stream={stream}/batch_id={batch_id}"
        if known_steps is None:
            intake(batch).write.mode("overwrite").partitionBy("outcome").parquet(place)
            return
        ids = scratch(batch.sparkSession, "step-ids")
        try:
            asked_steps(batch).write.parquet(ids)
            known = narrowed(known_steps, batch.sparkSession.read.schema("step_id string").parquet(ids))
            intake(batch, known).write.mode("overwrite").partitionBy("outcome").parquet(place)
        finally:
            storage.delete(batch.sparkSession, ids)

    return (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**pace(every))
        .start()
    )


def _batches(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """The micro-batches stored per stream, in order."""
    found = {}
    for stream in storage.children(spark, folder):
        if "/stream=" in stream:
            numbers = [c.rsplit("/batch_id=", 1)[1] for c in storage.children(spark, stream) if "/batch_id=" in c]
            found[stream.rsplit("/stream=", 1)[1]] = sorted(map(int, numbers))
    return found


def gather_results(spark: SparkSession, folder: str, gathered: str) -> None:
    """Move all micro-batches but the newest of each stream, the one that can still be replayed, into few
    files below `gathered`, so that a consumer that runs for long leaves no folder per batch behind.

    Each call writes one part, which counts once it is written to its end, and then deletes the folders
    it holds. `read_results` passes over folders that a call which died left undeleted, and so does
    the next call, which deletes them. Run one call at a time, while no reader uses the folder.
    """
    batches = _batches(spark, folder)
    upto = _gathered_upto(spark, gathered)
    closed = [
        (F.col("stream") == stream) & F.col("batch_id").between(upto.get(stream, -1) + 1, numbers[-2])
        for stream, numbers in batches.items()
        if len(numbers) > 1 and numbers[-2] > upto.get(stream, -1)
    ]
    if closed:
        rows = spark.read.parquet(folder).filter(reduce(or_, closed))
        part = f"{gathered}/part-{len(storage.children(spark, gathered)):08d}"
        rows.hint("rebalance", "stream", "outcome").write.partitionBy("stream", "outcome").parquet(part)
    for stream, numbers in batches.items():
        for number in numbers[:-1]:
            storage.delete(spark, f"{folder}/stream={stream}/batch_id={number}")


def _parts(spark: SparkSession, gathered: str) -> list[str]:
    parts = storage.children(spark, gathered)
    return [p for p in sorted(parts) if any(c.endswith("/_SUCCESS") for c in storage.children(spark, p))]


def _gathered(spark: SparkSession, gathered: str) -> DataFrame | None:
    """Rows of all parts that were written to their end."""
    parts = [spark.read.parquet(p) for p in _parts(spark, gathered)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _gathered_upto(spark: SparkSession, gathered: str) -> dict[str, int]:
    """The newest gathered micro-batch of each stream; one row per stream comes to the driver."""
    rows = _gathered(spark, gathered)
    return {} if rows is None else dict(rows.groupBy("stream").agg(F.max("batch_id")).collect())


def read_results(spark: SparkSession, folder: str, gathered: str) -> DataFrame:
    """All stored messages, each once: the gathered ones and those of micro-batches not gathered yet."""
    live, old = spark.read.parquet(folder), _gathered(spark, gathered)
    if old is None:
        return live
    seen = [
        (F.col("stream") == stream) & (F.col("batch_id") <= number)
        for stream, number in _gathered_upto(spark, gathered).items()
    ]
    return live.filter(~reduce(or_, seen)).unionByName(old.select(*live.columns))


def stored_patches(stored: DataFrame) -> DataFrame:
    """The step patches among stored messages (reads only the `updated` partitions)."""
    return step_patches(stored.filter(F.col("outcome") == "updated"))


def batch_summary(stored: DataFrame) -> DataFrame:
    """How many messages each micro-batch processed, per outcome and result status."""
    return stored.groupBy("stream", "batch_id", "outcome", "status").agg(F.count("*").alias("processed"))
