"""Approximate aggregates that add up: one sketch per group and day, merged for any range of days.

A stored row has, for each counted column, a HyperLogLog sketch of its distinct values, and for each measured
column a KLL sketch of its distribution, next to the exact number of rows. Rows are reduced before the
shuffle, so a hot group sends one sketch per task. A question reads the stored days of its range and none of
the rows; days are the table's partitions, so other days are not opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the registers of a HyperLogLog sketch, and the size of a KLL sketch.
REGISTERS, SIZE = 12, 400
#: Relative standard errors of estimated counts are 1.04 / sqrt(registers); bounds are this many of them.
SIGMAS = 4.0


def distinct_bound(registers: int = REGISTERS) -> float:
    """The relative error that an estimated count of distinct values keeps to, but for one case in ten thousand."""
    return SIGMAS * 1.04 / (2**registers) ** 0.5


def rank_bound(size: int = SIZE) -> float:
    """The error in rank, as a share of all rows, that an estimated quantile keeps to in all but rare cases."""
    return SIGMAS * 0.6 / size**0.9


def daily(
    rows: DataFrame, day: str, by: Sequence[str], counted: Sequence[str] = (), measured: Sequence[str] = ()
) -> DataFrame:
    """`day, by…, n, distinct_<column>…, spread_<column>…`: a row of sketches per day and group.

    Nulls are in no sketch; a day or group that is null is one of its own. Measured columns are read as doubles.
    """
    parts = [F.count("*").alias("n")]
    parts += [F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), REGISTERS).alias(f"distinct_{c}") for c in counted]
    parts += [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), SIZE).alias(f"spread_{c}") for c in measured]
    return rows.groupBy(F.to_date(F.col(f"`{day}`")).alias("day"), *by).agg(*parts)


def store(sketches: DataFrame, path: str, replace: bool = False) -> None:
    """Write days of sketches as partitions; with `replace`, days that are stored already are written anew."""
    writer = sketches.repartition("day").write.partitionBy("day")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The sketches of the days from `first` to `last`, both included."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows


def merged(
    sketches: DataFrame, by: Sequence[str], counted: Sequence[str] = (), quantiles: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """`by…, n, <column>_distinct…, <column>_quantiles…`: estimates over all given days.

    A column without values in a group has 0 distinct ones and null quantiles.
    """
    quantiles = quantiles or {}
    parts = [F.sum("n").alias("n")]
    parts += [F.hll_union_agg(f"distinct_{c}").alias(f"_d_{c}") for c in counted]
    parts += [F.kll_merge_agg_double(f"spread_{c}").alias(f"_s_{c}") for c in quantiles]
    whole = sketches.groupBy(*by).agg(*parts) if by else sketches.agg(*parts)
    shown = [F.hll_sketch_estimate(f"_d_{c}").alias(f"{c}_distinct") for c in counted]
    for c, wanted in quantiles.items():
        values = F.kll_sketch_get_quantile_double(f"_s_{c}", F.array(*[F.lit(float(q)) for q in wanted]))
        some = F.kll_sketch_get_n_double(f"_s_{c}") > 0
        shown.append(F.when(some, values).alias(f"{c}_quantiles"))
    return whole.select(*by, "n", *shown)
