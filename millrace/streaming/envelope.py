"""Opening message bodies: unwrap, decode with defaults and validity, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schemas

CORRUPT = "_corrupt"

# The topic each service takes its commands from.
COMMAND_TOPIC = {
    "storage": "storage-commands",
    "query": "query-commands",
    "transform": "transform-commands",
}

_SCHEMA = {
    "command": schemas.COMMAND_MESSAGE,
    # Read as text, so that a number in another form does not spoil the message.
    "result": schemas.RESULT_MESSAGE.replace("duration_ms int", "duration_ms string"),
    "event": schemas.EVENT_MESSAGE,
}
_REQUIRED = {
    "command": ("type", "action"),
    "result": ("status", "correlation_id"),
    "event": ("type",),
}


def unwrap(body: Column) -> Column:
    """The message itself, whether it came bare or as the `Message` text of a notification."""
    wrapped = F.when(body.contains('"Message"'), F.get_json_object(body, "$.Message"))
    return F.coalesce(wrapped, body)


def decode(raw: DataFrame, kind: str) -> DataFrame:
    """Typed fields, the raw `body` and its `position` if it has one, and `valid`: the text parsed and
    every required field is there.

    A missing correlation id is derived from the message text, so a redelivered message gets the
    same one; a missing timestamp is the batch's time.
    """
    message = F.from_json(
        unwrap(F.col("body")),
        f"{_SCHEMA[kind]}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    # A generated column: filters on its fields stay above it, so each message is parsed once.
    given = [c for c in ("body", "position") if c in raw.columns]
    parsed = raw.select(*given, F.explode(F.array(message)).alias("m"))
    valid = F.col("m").isNotNull() & F.col(f"m.{CORRUPT}").isNull()
    for field in _REQUIRED[kind]:
        valid = valid & F.col(f"m.{field}").isNotNull()
    if kind == "result":
        valid = valid & F.col("m.status").isin(*schemas.RESULT_STATUSES)
        # A whole number, also written as text or with zeros behind the point.
        number = F.col("m.duration_ms").try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) <= 2**31 - 1)
        valid = valid & (F.col("m.duration_ms").isNull() | F.coalesce(whole, F.lit(False)))

    when = F.try_to_timestamp("m.timestamp")
    valid = valid & (F.col("m.timestamp").isNull() | when.isNotNull())
    out = parsed.select(*given, F.coalesce(valid, F.lit(False)).alias("valid"), "m.*").drop(CORRUPT)
    out = out.withColumn(
        "timestamp", F.coalesce(F.try_to_timestamp("timestamp"), F.current_timestamp())
    )
    if kind != "result":
        derived = F.concat(F.lit("msg-"), F.substring(F.sha2(unwrap(F.col("body")), 256), 1, 32))
        out = out.withColumn("correlation_id", F.coalesce("correlation_id", derived))
    else:
        nothing = F.array()
        out = out.withColumns(
            {
                "duration_ms": F.coalesce(F.col("duration_ms").try_cast("double").try_cast("int"), F.lit(0)),
                "errors": F.coalesce("errors", nothing.cast("array<string>")),
            }
        )
    return out


def route(commands: DataFrame) -> DataFrame:
    """Adds the topic of each command's service; an unknown service gets none and an error text."""
    pairs = [F.lit(text) for pair in COMMAND_TOPIC.items() for text in pair]
    return commands.withColumn("topic", F.try_element_at(F.create_map(*pairs), F.col("type"))).withColumn(
        "route_error",
        F.when(F.col("topic").isNull(), F.concat(F.lit("Unknown service type: "), "type")),
    )
