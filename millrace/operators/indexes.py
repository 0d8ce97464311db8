"""Keyed reads: logs in buckets of their key, locations and text by postings.

All are plain catalog tables that appends keep up. A log in buckets answers for given ids from their buckets
alone, and its fold by that key needs no shuffle. The location index leads from a location to the steps that
ever named it, in one partition per hash of the location; the trigram index leads from three letters of
text to assets. Both only narrow what is read: the answer is computed from the records themselves, so
an entry that is out of date changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog

#: Partitions of a location index; the parts of one question come to the driver, at most this many.
PARTS = 64
GRAM = 3


# --- logs in buckets of their key -------------------------------------------------------------


def keep_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Append rows to a table in buckets of the key, made on first use with so many of them."""
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("append").saveAsTable(table)


def of_ids(spark: SparkSession, table: str, key: str, ids: Sequence[str]) -> DataFrame:
    """The rows of the given ids; only their buckets are read."""
    return spark.table(table).where(F.col(key).isin([i for i in dict.fromkeys(ids) if i is not None]))


# --- locations --------------------------------------------------------------------------------


def _part(location: str) -> Column:
    return F.pmod(F.xxhash64(location), F.lit(PARTS)).cast("int")


def index_locations(steps: DataFrame, table: str) -> None:
    """Append the locations that the steps, or patches of steps, name: `location, role, step_id`."""

    def named(role: str, column: str) -> Column:
        places = F.array_distinct(F.transform(column, lambda ref: ref["location"]))
        kept = F.filter(F.coalesce(places, F.array().cast("array<string>")), lambda p: p.isNotNull())
        return F.transform(kept, lambda p: F.struct(F.lit(role).alias("role"), p.alias("location")))

    rows = steps.select("step_id", F.inline(F.concat(named("producer", "outputs"), named("consumer", "inputs"))))
    rows = rows.select("location", "role", "step_id", _part("location").alias("part"))
    rows.hint("rebalance", "part").write.format("parquet").partitionBy("part").mode("append").saveAsTable(table)


def steps_naming(spark: SparkSession, table: str, locations: DataFrame, direction: str = "both") -> DataFrame:
    """`step_id` of the steps that ever named one of the locations; other partitions are not read."""
    wanted = locations.select("location").where("location is not null").distinct().withColumn("part", _part("location"))
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]
    rows = spark.table(table).where(F.col("part").isin(parts) if parts else F.lit(False))
    if direction != "both":
        rows = rows.where(F.col("role") == direction.removesuffix("s"))
    return rows.join(wanted, ["part", "location"], "left_semi").select("step_id").distinct()


# --- text -------------------------------------------------------------------------------------


def _grams(text: Column) -> Column:
    """The distinct three-letter pieces of a text in lower case."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    pieces = F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.coalesce(F.array_distinct(pieces), F.array().cast("array<string>"))


def index_text(assets: DataFrame, table: str, buckets: int) -> None:
    """Append `gram, name` for every piece of the assets' names and descriptions."""
    both = F.array_union(_grams(F.col("name")), _grams(F.col("description")))
    keep_bucketed(assets.select("name", F.explode(both).alias("gram")), table, "gram", buckets)


def names_with(spark: SparkSession, table: str, query: str) -> DataFrame | None:
    """`name` of the assets that may hold the text; None for a text too short to have pieces."""
    pieces = [r[0] for r in spark.range(1).select(F.explode(_grams(F.lit(query)))).collect()]
    if not pieces:
        return None
    met = of_ids(spark, table, "gram", pieces).groupBy("name").agg(F.countDistinct("gram").alias("n"))
    return met.where(F.col("n") == len(pieces)).select("name")


def search_indexed(
    assets: DataFrame, table: str, query: str, asset_type: str | None = None, tags: Sequence[str] | None = None
) -> DataFrame:
    """What `catalog.search` finds, comparing text only with assets that hold all pieces of the query.

    The index must cover the assets; names that it holds beside them do no harm. Shorter queries scan.
    """
    names = names_with(assets.sparkSession, table, query)
    some = assets if names is None else assets.join(names, "name", "left_semi")
    return catalog.search(some, query, asset_type, tags)
