"""Near-duplicates by SimHash: fingerprints, BK-trees over shards, distributed components.

A fingerprint has 64 bits; two documents are linked if at most `radius` bits differ. Cutting the
bits into radius + 1 blocks, two linked fingerprints agree in at least one block. A shard is the set
of distinct fingerprints with one value in one block; each shard has a BK-tree, whose children are
keyed by their Hamming distance to the parent, and a search follows only edges within the radius.
The trees of all shards together grow with the corpus, so they are not sent to every executor: a
tree meets only the fingerprints of its own block value. A shard above `capacity` is cut into
several trees, and each is searched by the whole shard, so no link is lost and no tree grows.
From each tree only the edges that join two of its parts are kept, at most one per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, short_batches, table, unused
from millrace.llm.components import components

SHINGLE = 3
RADIUS = 2
CAPACITY = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; 0 without words.

    bytes.lower changes A-Z alone, and bytes.split cuts at the six ASCII white-space characters.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    shifted = [words[i : i + count] for i in range(shingle)]
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*shifted, strict=True))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(g, 42) for g in grams])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprint_column(text: str | Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint. Null, empty and blank texts have 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


class BKTree:
    """A BK-tree over unsigned integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while True:
                distance = (value ^ self.values[at]).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = len(self.values)
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """All stored values at `radius` or fewer differing bits."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            children = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in children:
                    stack.append(children[edge])
        return found


class _Parts:
    """Union-find over the values of one tree and its searches."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def links(fingerprints: DataFrame, radius: int = RADIUS, capacity: int = CAPACITY) -> DataFrame:
    """`a, b`: links between the distinct bigints of `fingerprints(fp)` that connect all that are near.

    `fp` must be distinct and not null. Not every linked pair is listed, but the listed ones have the
    same components as all of them.
    """
    blocks = radius + 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    fp = F.col("fp")
    keys = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("int").alias("block"),
                    F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
                )
                for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
            ]
        )
    )
    placed = fingerprints.select(fp, keys.alias("k")).select("fp", "k.block", "k.value")
    sizes = placed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    trees = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    placed = placed.join(sizes, ["block", "value"]).withColumn("trees", trees)
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    placed = placed.withColumn("own", own).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    )
    placed = placed.select("block", "value", "tree", (F.col("own") != F.col("tree")).alias("guest"), "fp")
    spread = placed.repartition("block", "value", "tree")
    ordered = spread.sortWithinPartitions("block", "value", "tree", "guest", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, parts = None, BKTree(), _Parts()
        for batch in batches:
            a, b = [], []
            columns = (batch[c].tolist() for c in ("block", "value", "tree", "guest", "fp"))
            for block, value, shard, guest, signed in zip(*columns, strict=True):
                if key != (block, value, shard):
                    key, tree, parts = (block, value, shard), BKTree(), _Parts()
                x = signed & 0xFFFFFFFFFFFFFFFF
                for y in tree.within(x, radius):
                    if parts.join(x, y):
                        a.append(x)
                        b.append(y)
                if not guest:
                    tree.add(x)
            if a:
                yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return ordered.mapInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """`doc_id, fp, component_id`, one row per row of `docs`: the smallest id that links reach.

    Texts that are null, empty or blank share fingerprint 0 and are linked like any other. Rows with a
    null id belong to a component and can join others to it, but never name it; a component without
    any id has a null one. Repeated rows each keep their row. An empty table gives an empty result;
    other columns are ignored.
    """
    short_batches(docs)
    rows = docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(F.col(text_column), shingle).alias("fp"))
    rows = materialise(rows, "fingerprints")
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = components(links(smallest.select("fp"), radius))
    joined = smallest.join(near.withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fp"))
    joined = materialise(joined, "components")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(names, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all columns: the one that names the group.

    Rows that repeat id and text count as one. Different texts under one id each stay if the id names
    their group; texts without an id stay only where no other text of the group has one.
    """
    key = F.col(f"`{id_column}`")
    near = near_duplicates(docs, f"`{id_column}`", f"`{text_column}`")
    (name,) = unused(docs, "name")
    ids = near.where("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, key.eqNullSafe(F.col(name)), "left_semi").dropDuplicates([id_column, text_column])


@query("op9_simhash_bk_trees")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
