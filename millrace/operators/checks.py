"""Data tests and constraint checks.

Each test is a DataFrame of offending values. Values are counted before anything is joined, so
a value that fills a third of the table crosses the shuffle as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(frame: DataFrame, *columns: str) -> DataFrame:
    """Values (null apart) that occur more than once, with their count `n`."""
    rows = frame.select(*columns).dropna(how="any", subset=list(columns))
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def nulls(frame: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is null."""
    return frame.filter(F.col(column).isNull())


def orphans(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child values (null apart) that no parent row has, with the number `n` of child rows."""
    values = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = parent.select(F.col(field).alias(column)).distinct()
    return values.join(known, column, "left_anti")


def null_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and, per column, how many of them are null; a single pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return frame.agg(F.count("*").alias("row_count"), *counts)


def value_faults(frame: DataFrame, column: str) -> DataFrame:
    """One row: `repeated`, values (null apart) that occur more than once, and `nulls`, rows without a value."""
    counts = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    return counts.agg(
        F.count_if(known & (F.col("n") > 1)).alias("repeated"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
    )


def constraint_report(
    frame: DataFrame, required: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Rows `(rule, columns, failures)`: null rows per required column, repeated key values."""
    spark = frame.sparkSession
    report = spark.createDataFrame([], "rule string, columns string, failures bigint")
    if required:
        wide = null_counts(frame, required)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in required]))
        report = report.union(
            wide.select(pairs.alias("p")).select(F.lit("not_null"), "p.c", "p.n")
        )
    if keys:
        report = report.union(
            not_unique(frame, *keys).agg(
                F.lit("unique").alias("rule"), F.lit(",".join(keys)), F.count("*")
            )
        )
    return report
