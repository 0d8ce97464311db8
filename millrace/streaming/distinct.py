"""Result messages taken in once, although queues deliver them at least once.

Spark's state store remembers the messages of the last `delay` of event time and drops what comes again. It
also drops what is older than the watermark, seen before or not. Such late messages, and those whose
time is missing or lies in the future and so must not move the watermark, are found among all stored
messages by their keys and kept in a table of their own, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.messages import pace
from millrace.streaming.envelope import decode

#: What makes two deliveries the same message: a pending and a later success share the two ids.
KEY = ("correlation_id", "step_id", "timestamp")
#: As long as the queues keep a message.
DELAY = "1 day"


def distinct_results(raw: DataFrame, delay: str = DELAY) -> DataFrame:
    """The readable results of a stream, decoded, each once within `delay` of event time."""
    results = decode(raw, "result").filter(F.col("valid") & (F.col("timestamp") < F.current_timestamp())).drop("valid")
    return results.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(KEY))


def store_distinct(
    raw: DataFrame, folder: str, checkpoint: str, delay: str = DELAY, every: str | None = None
) -> StreamingQuery:
    """Append the distinct results of the stream to a folder; restarts with the checkpoint go on where it ended."""
    stream = distinct_results(raw, delay).writeStream.format("parquet").outputMode("append")
    return stream.option("path", folder).option("checkpointLocation", checkpoint).trigger(**pace(every)).start()


def late_results(stored: DataFrame, distinct: DataFrame) -> DataFrame:
    """The readable messages among all stored ones whose key no distinct result has, each key once.

    `stored` is what `consume_results` wrote. Run it over what both streams have taken in.
    """
    known = distinct.select(*[F.col(c).alias(f"_{c}") for c in KEY])
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    readable = stored.filter(~F.col("reason").eqNullSafe("unreadable message"))
    return readable.join(known, same, "left_anti").dropDuplicates(list(KEY))


def all_results(stored: DataFrame, distinct: DataFrame) -> DataFrame:
    """Every message once: the distinct ones and the late ones, told apart by `late`."""
    late = late_results(stored, distinct)
    fields = [c for c in distinct.columns if c in late.columns]
    return distinct.select(*fields, F.lit(False).alias("late")).unionByName(late.select(*fields, F.lit(True).alias("late")))
