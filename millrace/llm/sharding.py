"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents with equal texts form a group that stays together. Groups above a fixed share of a shard
are few; they are placed first, on the driver, heaviest first. All others are dealt by their hash to
cells, and every cell places its own groups against its part of what the shards still have room
for. Each group goes where the dot product of its sizes with the residual capacities is highest.
A group above a whole shard cannot stay together without breaking the balance: it is cut into
parts of a quarter shard, its rows dealt evenly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, materialise, query, table

#: A group above 1 / HEAVY of a shard in any dimension is placed by the driver: at most
#: 3 * HEAVY * shards rows.
HEAVY = 1000
#: Groups in a cell, which one task sorts and places.
CELL = 5_000
SIZES = ("bytes", "tokens", "rows")


def place(weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each group (rows of `weights`) in order; `room` is changed.

    Both are fractions of the whole corpus. Where no product differs the lowest shard wins.
    """
    chosen = np.zeros(len(weights), np.int32)
    for i, weight in enumerate(weights):
        chosen[i] = best = int(np.argmax(room @ weight))
        room[best] -= weight
    return chosen


def shards(
    docs: DataFrame, count: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`doc_id, size, text_crc32, shard, slot`, one row per row of `docs`.

    A null text has size 1, no tokens, no checksum, and all null texts are one group, apart from empty
    ones. Rows with null ids and repeated rows are rows like any other. An empty table gives an
    empty result; other columns are ignored.
    """
    spark, text = docs.sparkSession, F.col(text_column)
    blob = F.encode(text, "UTF-8")
    tokens = F.size(F.split(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+"))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(blob).alias("text_crc32"),
        F.when(F.length(text) > 0, tokens).otherwise(0).cast("long").alias("tokens"),
        F.md5(blob).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "sizes")
    groups = rows.groupBy("text_key").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    )
    groups = materialise(groups, "groups")
    totals = groups.agg(*[F.sum(c) for c in SIZES], F.count("*")).first()
    if not totals[3]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = np.maximum(np.array(totals[:3], float), 1.0)
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(SIZES, total, strict=True)])
    groups = groups.withColumn("share", share)
    parts = F.when(F.col("share") > 1 / count, F.ceil(F.col("share") * 4 * count)).otherwise(1).cast("int")
    groups = groups.withColumn("parts", parts)
    limit = 1 / (count * HEAVY)
    large = groups.where(F.col("share") > limit).orderBy(F.desc("share"), "text_key").collect()
    weights = [np.array([g[c] for c in SIZES], float) / total / g["parts"] for g in large for _ in range(g["parts"])]
    keys = [(g["text_key"], p) for g in large for p in range(g["parts"])]
    room = np.full((count, len(SIZES)), 1 / count)
    heavy = place(np.array(weights).reshape(-1, len(SIZES)), room)
    first = spark.createDataFrame(
        [(k, p, g["parts"], int(s)) for (k, p), g, s in zip(keys, [g for g in large for _ in range(g["parts"])], heavy, strict=True)],
        "text_key string, part int, parts int, shard int",
    )

    cells = max(1, -(-totals[3] // CELL))
    small = groups.where(F.col("share") <= limit).withColumn("cell", F.pmod(F.xxhash64("text_key"), F.lit(cells)).cast("int"))
    rest = np.array(small.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in SIZES]).first(), float) / total

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["share", "text_key"], ascending=[False, True])
        sizes = cell[list(SIZES)].to_numpy(float) / total
        own = room * np.where(rest > 0, sizes.sum(axis=0) / np.maximum(rest, 1e-300), 0.0)
        return pd.DataFrame({"text_key": cell["text_key"], "part": 0, "parts": 1, "shard": place(sizes, own)})

    # A cell is about CELL groups by their hash, whatever the corpus.
    light = small.groupBy("cell").applyInPandas(fill, "text_key string, part int, parts int, shard int")
    homes = materialise(first.unionByName(light), "homes")
    split = homes.where("parts > 1").select(F.col("text_key").alias("split_key"), "parts").distinct()
    cut = rows.join(F.broadcast(split), F.col("text_key").eqNullSafe(F.col("split_key")), "left")  # at most 8 texts
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")
    cut = cut.withColumn("part", part).drop("parts", "split_key")
    homes = homes.select(F.col("text_key").alias("home_key"), F.col("part").alias("home_part"), "shard")
    same = F.col("text_key").eqNullSafe(F.col("home_key")) & (F.col("part") == F.col("home_part"))
    return number(cut.join(homes, same).drop("home_key", "home_part"))


def number(placed: DataFrame) -> DataFrame:
    """Slots without gaps in every shard: ranks within salted parts plus the totals of those before."""
    salts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    placed = materialise(placed.withColumn("salt", salt), "placed")
    totals = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "row")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(totals, ["shard", "salt"])
    slot = (F.col("rank") + F.col("before")).cast("long").alias("slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", slot)


@query("op5_vector_bin_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = shards(table(spark, folder, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
