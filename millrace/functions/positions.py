"""Positions in a total order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import scratch


def positions(frame: DataFrame, *order: Column) -> DataFrame:
    """The frame with `position`, from 1 on, in the given order.

    The rows are sorted by ranges and written once with their range and their place in it; the
    ranges' sizes, one row each, are summed up and added.
    """
    spark = frame.sparkSession
    low = F.shiftright(F.monotonically_increasing_id(), 33)
    place = F.monotonically_increasing_id() - F.shiftleft(low, 33)
    folder = scratch(spark, "sorted")
    frame.orderBy(*order).select("*", low.alias("_range"), place.alias("_place")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    found = rows.join(starts, "_range").withColumn("position", F.col("_start") + F.col("_place") + 1)
    return found.select(*frame.columns, "position")
