"""Joins that stay even when one key owns a large share of the big side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with each key of `big` spread over as many tasks as the session
    has shuffle partitions and `small` repeated for each of them.

    The salt is a hash of `spread_by`, so a retried task puts every row where it was before. Worth
    it where a group-by on the same key follows, which keeps Spark from splitting the hot partition
    itself, and `small` has about one row per key. For inner, left, left_semi and left_anti joins.
    """
    count = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(count)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    return (
        big.withColumn("_salt", salt)
        .join(small.withColumn("_salt", salts), [*on, "_salt"], how)
        .drop("_salt")
    )
