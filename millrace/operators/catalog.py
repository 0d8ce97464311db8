"""The asset catalogue: an append-only log of registrations, folded to one row per name.

Log rows are the ASSET fields with `op` (`register` or `unregister`), `logged_at` and `seq`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from millrace.functions.skew import salted_join
from millrace.schemas import ASSET

ASSET_FIELDS = (
    "asset_type", "location", "description", "columns", "tags",
    "upstream", "downstream", "created_by", "metadata",
)
REQUIRED = ("name", "asset_type")
DIRECTIONS = ("upstream", "downstream", "both")


def registrations(assets: DataFrame) -> DataFrame:
    """Log rows for assets to register; what is left out gets its empty default.

    `name` and `asset_type` are required: rows without them are left out (see `rejected`).
    """
    filled = {f.name: _filled(assets, f) for f in StructType.fromDDL(ASSET) if f.name not in REQUIRED}
    return _complete(assets, True).withColumns(filled).withColumn("op", F.lit("register"))


def rejected(assets: DataFrame) -> DataFrame:
    """Assets that cannot be registered because a required field is missing."""
    return _complete(assets, False)


def _complete(assets: DataFrame, wanted: bool) -> DataFrame:
    given = [F.coalesce(F.col(c) != "", F.lit(False)) for c in REQUIRED]
    return assets.filter((given[0] & given[1]) == F.lit(wanted))


def _filled(assets: DataFrame, field: StructField) -> Column:
    """The asset's value or, by type, an empty list, map or text."""
    if isinstance(field.dataType, ArrayType):
        empty = F.array()
    elif isinstance(field.dataType, MapType):
        empty = F.create_map()
    else:
        empty = F.lit("")
    empty = empty.cast(field.dataType)
    if field.name not in assets.columns:
        return empty
    return F.coalesce(F.col(field.name).cast(field.dataType), empty)


def current_assets(log: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The newest registration of each name that is not unregistered; with `wanted` (name), of those names.

    A registration replaces the asset as a whole. `created_at` is the first registration after the
    name was last removed. The log itself is only aggregated, never shuffled row by row, apart from
    the registrations of names that were once removed: those are compared with the last removal.
    """
    if wanted is not None:
        log = log.join(wanted.select("name").distinct(), "name", "left_semi").select(*log.columns)
    order = F.struct("logged_at", "seq")
    registers = F.col("op") == "register"
    state = (
        log.groupBy("name")
        .agg(
            F.max_by(F.struct("op", *ASSET_FIELDS), order).alias("last"),
            F.min(F.when(registers, F.col("logged_at"))).alias("first_seen"),
            F.max("logged_at").alias("updated_at"),
        )
        .filter(F.col("last.op") == "register")
    )
    removed = log.filter(F.col("op") == "unregister").groupBy("name").agg(F.max(order).alias("cut"))
    reborn = (
        salted_join(
            log.filter(registers).select("name", "logged_at", "seq"), removed, ["name"], ["logged_at", "seq"]
        )
        .filter(order > F.col("cut"))
        .groupBy("name")
        .agg(F.min("logged_at").alias("reborn_at"))
    )
    return state.join(reborn, "name", "left").select(
        "name",
        *[F.col(f"last.{field}") for field in ASSET_FIELDS],
        F.coalesce("reborn_at", "first_seen").alias("created_at"),
        "updated_at",
    )


def unregister(assets: DataFrame, names: DataFrame) -> DataFrame:
    """The catalogue without the named assets."""
    return assets.join(names.select("name").distinct(), "name", "left_anti")


def unregister_report(assets: DataFrame, names: DataFrame) -> DataFrame:
    """For each name whether there was an asset to remove."""
    return get_assets(assets, names).select("name", F.col("found").alias("unregistered"))


def get_assets(assets: DataFrame, names: DataFrame) -> DataFrame:
    """The wanted assets; `found` is false and the rest null where there is none."""
    return (
        names.select("name").distinct().join(assets.withColumn("found", F.lit(True)), "name", "left")
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def search(
    assets: DataFrame,
    query: str | None = None,
    asset_type: str | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Assets meeting all criteria given: type, every one of the tags, text in name or description."""
    if asset_type:
        assets = assets.filter(F.col("asset_type") == asset_type)
    for tag in tags or ():
        assets = assets.filter(F.array_contains("tags", tag))
    if query:
        text = F.lower(F.lit(query))
        assets = assets.filter(
            F.lower("name").contains(text) | F.lower("description").contains(text)
        )
    return list_assets(assets)


def list_assets(assets: DataFrame) -> DataFrame:
    """All assets in name order."""
    return assets.orderBy("name")


def asset_lineage(assets: DataFrame, names: DataFrame | None = None, direction: str = "both") -> DataFrame:
    """Rows `(name, direction, other)` from the stored neighbour lists: one hop, as registered."""
    if direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {direction} (known: {', '.join(DIRECTIONS)})")
    if names is not None:
        assets = assets.join(names.select("name").distinct(), "name", "left_semi")
    sides = [d for d in ("upstream", "downstream") if direction in (d, "both")]
    ends = [_neighbours(side) for side in sides]
    edges = ends[0] if len(ends) == 1 else F.concat(*ends)
    return assets.select("name", F.inline(edges))


def _neighbours(side: str) -> Column:
    return F.transform(
        F.coalesce(side, F.array().cast("array<string>")),
        lambda other: F.struct(F.lit(side).alias("direction"), other.alias("other")),
    )


def stats(assets: DataFrame) -> DataFrame:
    """Rows `(kind, key, n)`: the total, assets by type, and tag uses (a repeated tag counts each time).

    One pass: each asset contributes its total, type and tag entries to a single count.
    """
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    entries = F.concat(
        F.array(entry("total", F.lit("")), entry("type", F.col("asset_type"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda tag: entry("tag", tag)),
    )
    return assets.select(F.inline(entries)).groupBy("kind", "key").agg(F.count("*").alias("n"))
