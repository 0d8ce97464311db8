"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Components are quantised to x = floor(scale * c). The fit list has each distinct vector once; its centred
rows are the matrix X, which stays distributed. A step of the bidiagonalisation is one pass over
the rows: with t the direction on the driver, p = Xt, the products of p with all earlier left vectors (full
reorthogonalisation), its length and Xᵀp are summed. Left vectors are never stored: each is X times a
vector as long as an embedding, so a task recomputes its rows of them. Right vectors are
reorthogonalised on the driver. The driver holds the two sets of vectors and the bidiagonal matrix,
whose singular value decomposition gives components and deviations. When a subspace is exhausted
the process goes on from a fresh vector. Once the wanted components have converged, a second run over
what is orthogonal to them shows that none as large was missed, as repeated eigenvalues can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, table

SCALE, COMPONENTS = 256.0, 4
#: Residuals of converged singular triplets, and directions that count as none, as a share of the largest value.
CONVERGED, NOTHING = 1e-14, 1e-11
#: A run that only confirms stops here: its largest value is known well enough to be compared.
CONFIRMED = 1e-9
LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """`vec_id, x` of the vectors that remain."""
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    fits = lambda c: c.isNotNull() & (F.abs(c * scale) < 2.0**63)  # noqa: E731  (NaN is above all numbers)
    whole = F.transform("vector", lambda c: F.floor(c * scale))
    return rows.where((F.size("vector") > 0) & F.forall("vector", fits)).select("vec_id", whole.alias("x"))


class Rows:
    """The centred fit list; sums over its rows."""

    def __init__(self, fit: DataFrame) -> None:
        self.fit = fit
        sums = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at")
        value = F.col("value").cast("decimal(38,0)")
        found = sums.agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.max(F.abs(value)).alias("top")).collect()
        found.sort(key=lambda r: r["at"])
        self.count = found[0]["n"] if found else 0
        self.sums = [int(r["s"]) for r in found]
        self.top = max((int(r["top"]) for r in found), default=0)
        self.size = len(found)

    def centred(self, x: pd.Series) -> np.ndarray:
        """Rows of X: whole parts are subtracted first, so that large offsets cost no digits."""
        near = np.array([s // self.count for s in self.sums])
        rest = np.array([s % self.count / self.count for s in self.sums])
        kind = np.int64 if self.top < 1 << 62 else float
        return (np.array(x.tolist(), kind) - near.astype(kind)).astype(float) - rest

    def summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of what `of` gives for each part of them, a short array."""
        centred = self.centred

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                if len(batch):
                    some = of(centred(batch["x"]))
                    total = some if total is None else total + some
            if total is not None:
                yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

        found = self.fit.mapInPandas(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        out = found.toPandas().sort_values("at")
        return out["value"].to_numpy()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "fit"}


def orthogonal(vector: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """What is left of the vector beside the columns of the bases; twice is enough."""
    for _ in range(2):
        for base in bases:
            vector = vector - base @ (base.T @ vector)
    return vector


def bidiagonalise(
    rows: Rows, found: np.ndarray, wanted: int, tolerance: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values of X beside the columns of `found`, and their right vectors.

    All values that there are, if the rest of the space is exhausted first.
    """
    size = rows.size
    right, left, sent = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros((size, 0))
    alpha, beta = [], []
    coupled = 0.0
    following = None
    most = size - found.shape[1]
    while True:
        if following is None:  # the first vector, or a fresh one where a subspace ended
            fresh = orthogonal(rng.standard_normal(size), found, right)
            following, coupled = fresh / np.linalg.norm(fresh), 0.0
        v = orthogonal(following, found, right)
        v /= np.linalg.norm(v)
        t = v - coupled * left[:, -1] if left.shape[1] else v
        held = left

        def product(x: np.ndarray, t: np.ndarray = t, held: np.ndarray = held) -> np.ndarray:
            p = x @ t
            return np.concatenate([[p @ p], (x @ held).T @ p, x.T @ p])

        sums = rows.summed(product)
        square, overlap, back = sums[0], sums[1 : 1 + left.shape[1]], sums[1 + left.shape[1] :]
        t, back = t - left @ overlap, back - sent @ overlap
        length = np.sqrt(max(0.0, square - overlap @ overlap))
        right = np.column_stack([right, v])
        largest = max([*alpha, *beta, length])
        alive = length > NOTHING * largest
        alpha.append(length if alive else 0.0)
        left = np.column_stack([left, t / length if alive else np.zeros(size)])
        sent = np.column_stack([sent, back / length if alive else np.zeros(size)])
        rest = orthogonal(sent[:, -1] - alpha[-1] * v, found, right)
        coupled = float(np.linalg.norm(rest))
        following = rest / coupled if coupled > NOTHING * largest else None
        steps = len(alpha)
        matrix = np.diag(alpha) + np.diag(beta, 1)
        inner, values, outer = np.linalg.svd(matrix)
        known = min(wanted, steps)
        residual = np.abs((coupled if following is not None else 0.0) * inner[-1, :known])
        settled = following is not None and steps >= wanted and (residual <= tolerance * max(values[0], 1e-300)).all()
        if steps == most or settled:
            return values[:known], right @ outer[:known].T
        beta.append(coupled if following is not None else 0.0)


def components(rows: Rows, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance and unit eigenvectors as columns, by falling value; null ones are left out."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, rows.size)
    if rows.count < 2 or not wanted:
        return np.zeros(0), np.zeros((rows.size, 0))
    values, vectors = bidiagonalise(rows, np.zeros((rows.size, 0)), wanted, CONVERGED, rng)
    while vectors.shape[1] < rows.size:  # another copy of a repeated value is met by a run of its own
        more, others = bidiagonalise(rows, vectors, 1, CONFIRMED, rng)
        if more[0] <= (1 - 10 * CONFIRMED) * values[wanted - 1] or more[0] <= NOTHING * values[0]:
            break
        more, others = bidiagonalise(rows, vectors, 1, CONVERGED, rng)
        values, vectors = np.append(values, more), np.column_stack([vectors, others])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        if order[-1] == len(order) - 1 and len(order) > wanted:
            break
    values, vectors = values[:wanted], np.linalg.qr(vectors)[0][:, :wanted]
    real = values > NOTHING * max(values[0], 1e-300)
    return values[real] ** 2 / rows.count, vectors[:, real]


def deviations(x: np.ndarray, count: int, sums: list[int], top: int) -> list[int | None]:
    """The exact sum over dimensions of (count * x - sum)²; null beyond 64 bits."""
    if len(sums) * (2 * count * top) ** 2 <= LONGEST:
        part = count * x - np.array(sums)
        return (part * part).sum(axis=1).tolist()
    exact = (sum((count * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    return [value if value <= LONGEST else None for value in exact]


def whitened(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = SCALE,
    wanted: int = COMPONENTS,
) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`, a row per vector and component.

    Vectors that are null or empty, hold null or non-finite entries or ones whose quantised value is beyond
    64 bits are dropped. So are vectors of other lengths than most have (the shorter of two equally
    common). Repeated rows each give their rows; a null id stays null. Components without
    variance are none, so fewer than `wanted` may come, and none from fewer than two distinct vectors
    or an empty table. A deviation beyond 64 bits is null. Other columns are ignored.
    """
    rows = materialise(quantised(vectors, f"`{id_column}`", f"`{vector_column}`", scale), "vectors")
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("x") == (lengths[0]["size"] if lengths else 0))
    fit = Rows(materialise(rows.select("x").distinct(), "fit"))
    values, basis = components(fit, wanted)
    number = len(values)
    scaled = basis / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.concatenate([[(x * x).sum()], z.sum(axis=0), (z.T @ z).ravel()])

    trace, error = 1.0, 0.0
    if number:
        sums = fit.summed(moments) / fit.count
        mean, square = sums[1 : 1 + number], sums[1 + number :].reshape(number, number)
        trace, error = float(sums[0]), float(np.abs(square - np.outer(mean, mean) - np.eye(number)).max())
    count, totals, top, centred = fit.count, fit.sums, fit.top, fit.centred

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["x"].tolist())
                exact = [None if d is None else Decimal(d) for d in deviations(x, count, totals, top)]
                parts = list(centred(batch["x"]) @ scaled)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "exact": exact, "parts": parts})

    # Ids as text and sums as decimals: pandas would turn whole numbers beside nulls into doubles.
    given = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    found = given.mapInPandas(project, "vec_id string, exact decimal(38,0), parts array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return found.select("*", F.posexplode("parts").alias("at", "whitened")).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(count).cast("long").alias("n"),
        F.col("exact").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op13_bidiagonal_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))
