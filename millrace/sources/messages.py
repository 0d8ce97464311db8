"""JSON messages in and out. A raw message is one row with a `body` text and, from a source that knows
the order of arrival, its `position`, which settles which of two results of one time is the later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The attributes each message kind is published with.
ATTRIBUTES = {
    "command": ("type", "action", "correlation_id"),
    "result": ("status", "correlation_id"),
    "event": ("type", "correlation_id"),
}
# The attribute with few values by which files are laid out.
ROUTED_BY = {"command": "type", "result": "status", "event": "type"}

# Absent fields are written as null, and times keep their microseconds.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def message_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the lines of text files arriving in a folder; the position is the file's time in
    milliseconds, which the lines of a file share."""
    reader = spark.readStream.schema("body string").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    when = F.unix_millis("_metadata.file_modification_time")
    return reader.text(folder).select("body", when.alias("position"))


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, rows_per_batch: int | None = None
) -> DataFrame:
    """A stream of the values of a topic with their offsets; needs Spark's Kafka package on the class path.

    Offsets order the messages of one partition, so results of one step must share a key.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return reader.option("subscribe", topic).load().select(
        F.col("value").cast("string").alias("body"), F.col("offset").alias("position")
    )


def encode(messages: DataFrame, kind: str) -> DataFrame:
    """Messages as JSON text next to the attributes they are routed by."""
    body = F.to_json(F.struct("*"), JSON_OPTIONS)
    return messages.select(*ATTRIBUTES[kind], body.alias("body"))


def kafka_rows(messages: DataFrame, kind: str) -> DataFrame:
    """Key, value and headers in the layout of Spark's Kafka writer."""
    encoded = encode(messages, kind)
    headers = [
        F.struct(F.lit(name).alias("key"), F.encode(F.col(name), "UTF-8").alias("value"))
        for name in ATTRIBUTES[kind]
    ]
    return encoded.select(
        F.col("correlation_id").alias("key"),
        F.col("body").alias("value"),
        F.array(*headers).alias("headers"),
    )


def publish(messages: DataFrame, kind: str, folder: str) -> None:
    """Append messages as JSON lines, one sub-folder per value of the routing attribute."""
    encode(messages, kind).select(ROUTED_BY[kind], "body").write.mode("append").partitionBy(
        ROUTED_BY[kind]
    ).text(folder)


def pace(every: str | None) -> dict[str, object]:
    """Trigger settings: a micro-batch per interval, or all that is there now and then the end."""
    return {"processingTime": every} if every else {"availableNow": True}


def publish_stream(
    messages: DataFrame, kind: str, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """The same as a stream."""
    return (
        encode(messages, kind)
        .select(ROUTED_BY[kind], "body")
        .writeStream.format("text")
        .partitionBy(ROUTED_BY[kind])
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(**pace(every))
        .start()
    )
