"""Near-duplicate embeddings: random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class with a count. A table hashes a vector to the signs of its products with
a few random hyperplanes. The number of signs follows the number of classes, so that a bucket
holds about `bucket` of them, and the number of tables follows from the wanted recall for a pair at
the threshold itself; closer pairs are found more surely. Vectors of one bucket are compared exactly
as blocks of a matrix product. A bucket above `block` vectors is cut into parts, and every two parts
meet in a task of their own, so no task grows and no pair is lost. Pairs are counted where they first
meet and never written: a task returns the sums of links per class and, for the components, one
edge per class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, table
from millrace.llm.components import components

THRESHOLD = 0.9
RECALL = 0.999
BUCKET = 256
BLOCK = 2048
SEED = 20


def tables_and_bits(classes: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """Number of tables and of signs in each."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(0, min(60, math.ceil(math.log2(max(1, classes) / bucket)))) if classes > bucket else 0
    hit = agree**bits
    return (1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))), bits


def signatures(classes: DataFrame, count: int, bits: int, seed: int = SEED) -> DataFrame:
    """`classes` with `buckets`, the bucket of each vector in every table."""

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for vector in batch["vector"]:
                size = len(vector)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((count, bits, size))
                found.append((planes[size] @ np.asarray(vector, float) >= 0) @ weights)
            yield batch.assign(buckets=[f.astype(np.int64) for f in found])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInPandas(sign, f"{schema}, buckets array<long>")


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two parts of one bucket of one table: `class_id, links, root`.

    The rows of the first part are compared with those of the second; both are the same where the
    parts are. A pair that shares a bucket in an earlier table was counted there.
    """
    number, first, second = (int(rows[c].iloc[0]) for c in ("number", "first", "second"))
    rows = rows.sort_values("class_id", kind="stable")
    unit = np.array(rows["vector"].tolist(), float)
    unit /= np.abs(unit).max(axis=1, keepdims=True)  # squares of huge or tiny components stay in range
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    part, ids, weight = rows["part"].to_numpy(), rows["class_id"].to_numpy(), rows["members"].to_numpy()
    seen = np.array(rows["buckets"].tolist(), np.int64).reshape(len(rows), -1)
    left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
    linked = np.zeros(len(rows), np.int64)
    label = np.arange(len(rows))
    pairs_a, pairs_b = [], []
    for low in range(0, len(left), 256):
        a = left[low : low + 256]
        near = unit[a] @ unit[right].T >= threshold
        if first == second:
            near &= right[None, :] > a[:, None]
        for earlier in range(number):
            if not near.any():
                break
            near &= seen[a, earlier][:, None] != seen[right, earlier][None, :]
        if near.any():
            linked[a] += near @ weight[right]
            linked[right] += weight[a] @ near
            i, j = np.nonzero(near)
            pairs_a.append(a[i].astype(np.int32))
            pairs_b.append(right[j].astype(np.int32))
    if pairs_a:
        i, j = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
    at = np.flatnonzero(linked)
    return pd.DataFrame({"class_id": ids[at], "links": linked[at], "root": ids[label[at]]})


def class_links(signed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """`class_id, links, root`, several rows per class: links to other classes, counted by members."""
    spread = signed.select("*", F.posexplode("buckets").alias("number", "bucket"))
    spread = spread.withColumn("size", F.size("vector"))
    keys = ["number", "bucket", "size"]
    large = spread.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block)
    spread = spread.join(large, keys, "left")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("int")
    spread = spread.withColumn("parts", parts)
    spread = spread.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = spread.withColumn("other", other).select(
        "*", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second")
    )
    met = met.select(*keys, "first", "second", "part", "class_id", "members", "vector", "buckets")
    return met.groupBy(*keys, "first", "second").applyInPandas(
        lambda rows: compare(rows, threshold), "class_id long, links long, root long"
    )


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """`vec_id, n_links, component_id, kept`, one row per row of `vectors`.

    A vector that is null, empty or zero or holds null or non-finite components links with nothing, and
    so does one without an id, whose component is null. Vectors of different lengths never link. Repeated
    rows are vectors of their own; an id that stands for several vectors is one node of the components.
    An empty table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = materialise(rows.withColumn("sound", sound), "vectors")
    classes = rows.where("sound").groupBy("vector").agg(
        F.min("vec_id").cast("long").alias("class_id"), F.count("*").alias("members")
    )
    classes = materialise(classes, "classes")
    count, bits = tables_and_bits(classes.count(), threshold, recall, bucket)
    signed = materialise(signatures(classes, count, bits), "signed")
    found = materialise(class_links(signed, threshold, block), "links")
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    near = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    known = classes.join(linked, "class_id", "left").join(
        near.withColumnRenamed("node", "class_id"), "class_id", "left"
    )
    known = known.select(
        F.col("vector").alias("known"),
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id"),
    )
    known = materialise(known, "known")
    rows = rows.withColumn("probe", F.when(F.col("sound"), F.col("vector")))
    joined = rows.join(known, F.col("probe") == F.col("known"), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


@query("op2_hyperplane_tables")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
