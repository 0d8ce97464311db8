"""Connected components as alternating large-star and small-star rounds.

Every round is two grouped minima and two joins. Neighbour lists are never collected: a node with a
million neighbours is a million rows that adaptive execution can split. Rounds grow with the
logarithm of the longest path. Each round is written below spark.checkpoint.dir, so a lost executor
repeats one round at most and the plan stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """`node, component` for every node on an edge; component is the smallest node reachable.

    Nulls on either side and loops are no edges; repeated edges count once.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = materialise(pairs, "edges")
    mark = _mark(pairs)
    while True:
        pairs = materialise(_small_star(_large_star(pairs)), "edges")
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )
    return moved.where("u <> v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
