"""Exact top-k search by inner product with KD-trees per shard.

Components are quantised to floor(scale * x) and scores are integer inner products, so results are exact.
Equal vectors are one class: of each class only the `k + 1` rows of the smallest ids can be among the
first k of any query, its own row included, so no more are kept, and equal queries are searched once.

Cells come from median splits of a bounded sample (`SAMPLE` rows); every row is put in a cell, and a cell
above `capacity` is cut into shards by hash. A task builds the KD-tree of one shard: median splits of the
widest dimension down to small leaves, each node with the tight bounding box of its vectors. A search
goes best first: from the root, every query takes the open node with the largest possible product of
query and box, until that bound is below its kth score. Queries first search one shard of their own cell.
The kth score found there travels with them; they visit only shards of cells whose box can
reach it. Large sets of queries meet a shard in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, table

SCALE, TOP, EVERY = 64.0, 20, 20
#: Rows whose vectors fit the splits into cells; every row is indexed.
SAMPLE = 1 << 14
MOST_CELLS = 1 << 10
CAPACITY = 1 << 12
LEAF = 128
#: Queries that descend a tree together.
ABREAST = 512
#: Id by which rows without an id are ordered: after all others.
LAST = (1 << 63) - 1
EXACT = 1 << 53


def pack(values: np.ndarray) -> bytes:
    """Whole numbers held as doubles, in the fewest bytes each; the first byte names the kind."""
    top = np.abs(values).max(initial=0)
    kind = "b" if top < 1 << 7 else "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
    return kind.encode() + values.astype(kind).tobytes()


def unpack(packed: pd.Series) -> np.ndarray:
    """A matrix of packed vectors of one length: doubles, or Python integers where doubles are not exact."""
    rows = np.array([np.frombuffer(p, bytes(p[:1]).decode(), offset=1).astype(float) for p in packed])
    rows = rows.reshape(len(packed), -1)
    return rows if np.abs(rows).max(initial=0) < EXACT else np.array([[int(x) for x in r] for r in rows], object)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """`row_id, vec_id, order_id, size, packed` of the vectors that take part."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [pack(np.floor(scale * np.asarray(v, float)) + 0.0) for v in batch["vector"]]
            yield batch[["row_id", "order_id", "named", "size"]].assign(packed=packed)

    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf"))  # noqa: E731  (NaN is above infinity)
    rows = rows.where(F.forall("vector", finite)).select(
        F.monotonically_increasing_id().alias("row_id"),
        F.coalesce("vec_id", F.lit(LAST)).alias("order_id"),
        F.col("vec_id").isNotNull().alias("named"),
        F.size("vector").alias("size"),
        "vector",
    )
    return rows.mapInPandas(of, "row_id long, order_id long, named boolean, size int, packed binary")


class KDTree:
    """Median splits of the widest dimension, with the tight box of every node; children stand side by side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order, self.spans, left = np.arange(len(points)), [(0, len(points))], []
        low, high = [], []
        while len(left) < len(self.spans):
            start, end = self.spans[len(left)]
            held = points[self.order[start:end]]
            low.append(held.min(axis=0))
            high.append(held.max(axis=0))
            wide = high[-1] - low[-1]
            if end - start <= leaf or not (wide > 0).any():
                left.append(-1)
                continue
            along = held[:, int(np.argmax(wide))]
            self.order[start:end] = self.order[start:end][np.argsort(along, kind="stable")]
            middle = (start + end) // 2
            left.append(len(self.spans))
            self.spans += [(start, middle), (middle, end)]
        self.left, self.low, self.high = np.array(left), np.array(low), np.array(high)
        self.points = points[self.order]

    def search(self, asked: np.ndarray, floor: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the `count` best points of each query, -inf and -1 behind the last.

        Points below a query's floor may be missing. `ids` decides between equal scores.
        """
        bounds = box_bounds(asked, self.low, self.high)
        ids = np.append(ids[self.order], LAST)  # the last one stands for none
        each = np.arange(len(asked))
        waiting = np.zeros(bounds.shape, bool)
        waiting[:, 0] = True
        score = np.full((len(asked), count), -np.inf, asked.dtype)
        place = np.full((len(asked), count), -1)
        while True:
            at = np.where(waiting, bounds, -np.inf).argmax(axis=1)
            kth = np.maximum(score[:, -1], floor)
            live = np.flatnonzero(waiting[each, at] & (bounds[each, at] >= kth))
            if not len(live):
                return score, np.where(place < 0, -1, self.order[place])
            node = at[live]
            waiting[live, node] = False
            inner = self.left[node] >= 0
            waiting[live[inner], self.left[node[inner]]] = True
            waiting[live[inner], self.left[node[inner]] + 1] = True
            for leaf in np.unique(node[~inner]):
                rows = live[node == leaf]
                start, end = self.spans[leaf]
                found = asked[rows] @ self.points[start:end].T
                useful = found.max(axis=1) >= kth[rows]
                rows, found = rows[useful], found[useful]
                if not len(rows):
                    continue
                every = np.concatenate([score[rows], found], axis=1)
                where = np.concatenate([place[rows], np.broadcast_to(np.arange(start, end), found.shape)], axis=1)
                best = best_first(every, ids[where], count)
                score[rows] = np.take_along_axis(every, best, 1)
                place[rows] = np.take_along_axis(where, best, 1)


def box_bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest product that each query can have with a vector inside each box."""
    return np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T


def best_first(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` highest scores of each row, equal ones by id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    by_score = np.argsort(-np.take_along_axis(score, by_id, 1), axis=1, kind="stable")
    return np.take_along_axis(by_id, by_score, 1)[:, :count]


def whole_numbers(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices as they are if doubles hold all their products, else as Python integers."""
    top = 1
    for m in matrices:
        top *= int(np.abs(m).max(initial=1))
    if top * max(1, matrices[0].shape[1]) < EXACT:
        return list(matrices)
    return [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in matrices]


Splits = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of the median splits of a whole tree of `depth` levels, node by node."""
    dims, values = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    held = {0: points}
    for node in range(len(dims)):
        mine = held.pop(node)
        if len(mine) and mine.shape[1]:
            dims[node] = np.argmax(mine.max(axis=0) - mine.min(axis=0))
            values[node] = np.median(mine[:, dims[node]])
        right = mine[:, dims[node]] > values[node] if mine.shape[1] else np.zeros(len(mine), bool)
        held[2 * node + 1], held[2 * node + 2] = mine[~right], mine[right]
    return dims, values


def cells_of(points: np.ndarray, splits: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The cell of each point; 0 without splits."""
    node = np.zeros(len(points), int)
    if splits is None or not points.shape[1]:
        return node
    dims, values = splits
    while len(node) and node[0] < len(dims):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > values[node])
    return node - len(dims)


def placed(rows: DataFrame, splits: Splits) -> DataFrame:
    """`rows(…, size, packed)` with the cell of each vector."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = pd.Series(0, index=batch.index)
            for size, some in batch.groupby("size"):
                cells[some.index] = cells_of(unpack(some["packed"]), splits.get(size))
            yield batch.assign(cell=cells)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(of, f"{schema}, cell int")


def boxes(rows: DataFrame) -> DataFrame:
    """`size, cell, low, high`: the tight box of each cell."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (size, cell), some in batch.groupby(["size", "cell"]):
                points = unpack(some["packed"]).astype(float)
                low, high = points.min(axis=0), points.max(axis=0)
                yield pd.DataFrame({"size": size, "cell": cell, "at": np.arange(size), "low": low, "high": high})

    parts = rows.mapInPandas(of, "size int, cell int, at int, low double, high double")
    sides = parts.groupBy("size", "cell", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    box = F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("box")
    return sides.groupBy("size", "cell").agg(box).select("size", "cell", "box.low", "box.high")


def reached(asked: DataFrame, known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """`asked(class_id, size, packed, floor)` for each `cell` that can hold something as good as the floor."""

    def cells(size: int, points: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        if size not in known:
            return [np.zeros(1, int)] * len(points)
        names, low, high = known[size]
        top = np.abs(points).max(initial=1) * max(np.abs(low).max(initial=1), np.abs(high).max(initial=1))
        if top * max(1, size) >= EXACT:  # bounds in doubles would not be exact
            return [names] * len(points)
        return [names[row] for row in box_bounds(points, low, high) >= floor[:, None]]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, some in batch.groupby("size"):
                found = cells(int(size), unpack(some["packed"]), some["floor"].to_numpy(float))
                yield some.assign(cells=found)

    schema = "class_id long, size int, packed binary, floor double, cells array<int>"
    found = asked.select("class_id", "size", "packed", "floor").mapInPandas(of, schema)
    return found.select("class_id", "size", "packed", "floor", F.explode("cells").alias("cell"))


def visit(held: DataFrame, pairs: DataFrame, count: int, block: int) -> DataFrame:
    """`class_id, score, order_id, row_id, named`: what queries find in the shards that they are paired with.

    `held` has rows of shards (size, cell, part), `pairs` has class_id, packed and floor of queries for a shard.
    """
    shard = ["size", "cell", "part"]
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block))).cast("int").alias("blocks")
    sizes = pairs.groupBy(*shard).agg(blocks)
    pairs = pairs.join(sizes, shard).withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks").cast("int"))
    held = held.join(sizes, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"class_id": [], "score": [], "order_id": [], "row_id": [], "named": []}
        if len(rows) and len(asked):
            points, wanted = whole_numbers(unpack(rows["packed"]), unpack(asked["packed"]))
            ids, tree = rows["order_id"].to_numpy(), KDTree(points)
            for at in range(0, len(asked), ABREAST):
                some = asked.iloc[at : at + ABREAST]
                floor = some["floor"].to_numpy(float)
                score, place = tree.search(wanted[at : at + ABREAST], floor, ids, count)
                i, j = np.nonzero((place >= 0) & (score >= floor[:, None]))
                out["class_id"].append(some["class_id"].to_numpy()[i])
                out["score"].append([max(-LAST - 1, min(LAST, int(x))) for x in score[i, j]])
                for name in ("order_id", "row_id", "named"):
                    out[name].append(rows[name].to_numpy()[place[i, j]])
        kinds = {"named": bool}
        return pd.DataFrame({n: np.concatenate([np.zeros(0, kinds.get(n, np.int64)), *v]) for n, v in out.items()})

    left = held.select(*shard, "block", "row_id", "order_id", "named", "packed").groupBy(*shard, "block")
    right = pairs.select(*shard, "block", "class_id", "packed", "floor").groupBy(*shard, "block")
    return left.cogroup(right).applyInPandas(
        search, "class_id long, score long, order_id long, row_id long, named boolean"
    )


def first(found: DataFrame, count: int) -> DataFrame:
    """The first `count` finds of each class of queries."""
    along = Window.partitionBy("class_id").orderBy(F.desc("score"), "order_id", "row_id")
    return found.withColumn("place", F.row_number().over(along)).where(F.col("place") <= count)


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = TOP, every: int = EVERY,
    scale: float = SCALE, capacity: int = CAPACITY, sample: int = SAMPLE,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` highest scores of each row whose id `every` divides.

    Candidates are all rows but the query's own row; ties go to the smaller id. Vectors that are null or
    hold null or non-finite components (also once scaled) take no part; empty vectors score 0 with each
    other. Only vectors of one length meet. Rows without an id are candidates, behind all others of
    their score, with a null vec_id. A row that repeats an id is a query and a candidate of its own. Scores
    beyond 64 bits are set to the nearest one. A query without candidates has no rows, so an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, f"`{id_column}`", f"`{vector_column}`", scale), "vectors")
    copies = Window.partitionBy("size", "packed").orderBy("order_id", "row_id")
    held = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    held = materialise(held, "classes")
    number = held.count()
    some = held.select("size", "packed").orderBy(F.xxhash64("packed"), "packed").limit(sample).toPandas()
    wanted = min(MOST_CELLS, -(-number // capacity), max(1, len(some) // 16))
    depth = (wanted - 1).bit_length()
    splits = {int(s): fit_cells(unpack(p["packed"]).astype(float), depth) for s, p in some.groupby("size")}
    held = placed(held, splits)
    counts = held.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(capacity)).cast("int").alias("parts"))
    parts = materialise(counts, "parts")
    held = held.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("row_id"), "parts").cast("int"))
    held = materialise(held.drop("parts"), "shards")
    fitted = boxes(held.where(F.col("size").isin(list(splits)))).toPandas()
    known = {
        int(s): (b["cell"].to_numpy(), np.array(b["low"].tolist()), np.array(b["high"].tolist()))
        for s, b in fitted.groupby("size")
        if s
    }

    queries = rows.where(F.col("named") & (F.col("order_id") % every == 0)).select("row_id", "order_id", "size", "packed")
    asked = queries.groupBy("size", "packed").agg(F.min("row_id").alias("class_id"))
    asked = placed(asked, splits).withColumn("floor", F.lit(float("-inf")))
    home = F.pmod(F.xxhash64("class_id"), "parts").cast("int")
    asked = materialise(asked.join(parts, ["size", "cell"]).withColumn("home", home).drop("parts"), "asked")
    near = materialise(visit(held, asked.withColumnRenamed("home", "part"), k + 1, capacity), "near")
    near = materialise(first(near, k + 1), "near")
    kth = near.where(F.col("place") == k + 1).select("class_id", F.col("score").cast("double").alias("kth"))
    bounded = asked.join(kth, "class_id", "left")
    floor = F.when(F.abs("kth") < EXACT, F.col("kth")).otherwise(F.lit(float("-inf")))
    bounded = bounded.withColumn("floor", floor)
    pairs = reached(bounded, known).join(parts, ["size", "cell"])
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seen = asked.select("class_id", "size", "cell", F.col("home").alias("part"))
    pairs = pairs.join(seen, ["class_id", "size", "cell", "part"], "left_anti")
    far = visit(held, pairs, k + 1, capacity)
    best = first(near.drop("place").unionByName(far), k + 1)
    listed = F.sort_array(F.collect_list(F.struct("place", "score", "order_id", "row_id", "named"))).alias("best")
    best = materialise(best.groupBy("class_id").agg(listed), "best")
    classes = asked.select("class_id", "size", "packed").join(best, "class_id")
    answered = queries.join(classes, ["size", "packed"])
    others = F.slice(F.filter("best", lambda x: x["row_id"] != F.col("row_id")), 1, k)
    ranked = answered.select(F.col("order_id").alias("query_id"), F.posexplode(others).alias("at", "found"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.when(F.col("found.named"), F.col("found.order_id")).alias("vec_id"),
        F.col("found.score").alias("score"),
    )


SQL = """
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) q
           from embeddings
           where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pairs as (select a.vec_id query_id, b.vec_id,
                 cast(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) as bigint) score
          from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank,
                  vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


@query("op11_kd_trees", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
