"""Notifications about finished operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_events(results: DataFrame) -> DataFrame:
    """One event per result: `<handler>.<status>` with the result's ids and data as payload."""
    ids = F.map_filter(
        F.create_map(
            F.lit("job_id"), F.col("job_id"),
            F.lit("step_id"), F.col("step_id"),
            F.lit("duration_ms"), F.col("duration_ms").cast("string"),
        ),
        lambda _, value: value.isNotNull(),
    )
    data = F.map_filter(
        F.coalesce("data", F.create_map().cast("map<string,string>")),
        lambda key, _: ~key.isin("job_id", "step_id", "duration_ms"),
    )
    return results.select(
        F.concat_ws(".", "handler", "status").alias("type"),
        F.map_concat(ids, data).alias("payload"),
        "correlation_id",
        "timestamp",
        F.col("handler").alias("source"),
    )
