"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed per document from the bytes and words of the whole text. Trees are grown on
binned statistics, level by level, from histograms of gradients and Hessians. All trees are kept in
flat arrays of equal size per tree, in the order of a heap, so that a batch of documents walks
down a tree with one numpy step per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, query, short_batches, table
from millrace.llm.toxicity import labelled

#: Labelled documents at most that the trees are fitted on, by the hash of their id.
FIT = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 60, 0.2, 1.0, 5.0

FEATURES = (
    "log_words", "word_length", "distinct_words", "adjacent_repeats", "commonest_word", "repeated_lines",
    "words_per_line", "upper", "digits", "symbols", "exclamation", "pipes", "stops", "commas", "spaces",
    "beyond_ascii", "ends_in_letter",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; zeros for null, empty and blank ones."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    blob = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(blob, np.uint8), minlength=256)
    n, size = len(words), len(blob)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    share = lambda signs: float(sum(count[ord(s)] for s in signs)) / n
    return [
        math.log1p(n),
        (size - int(count[[9, 10, 11, 12, 13, 32]].sum())) / n,
        len(seen) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(seen.values()) / n,
        1 - len(set(lines)) / len(lines),
        math.log(n / len(lines)),
        float(count[65:91].sum()) / letters,
        float(count[48:58].sum()) / size,
        share("#*$%&<>"),
        share("!"),
        share("|"),
        share("."),
        share(","),
        float(count[[9, 10, 11, 12, 13, 32]].sum()) / size,
        float(count[128:].sum()) / size,
        sum(map(str.isalpha, (w[-1] for w in words))) / n,
    ]


@dataclass
class Trees:
    """Trees as arrays of shape (trees, nodes); node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = int(math.log2(self.feature.shape[1] + 1)) - 1 if self.feature.size else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss. One class alone gives its prior and no trees."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    nodes, bias = 2 ** (depth + 1) - 1, math.log(prior / (1 - prior))
    if len(y) == 0 or y.min() == y.max():
        empty = np.zeros((0, nodes))
        return Trees(empty.astype(int), empty, empty, bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    feature = np.zeros((trees, nodes), np.int64)
    cut, value = np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    margin = np.full(len(y), bias)
    width = x.shape[1]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            shape = (wide, width, BINS)
            sums = [
                np.bincount(cell.ravel(), np.repeat(v, width), wide * width * BINS).reshape(shape).cumsum(axis=2)
                for v in (gradient, hessian)
            ]
            g, h = sums
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
            least = LEAST * prior * (1 - prior)
            gain[(h < least) | (whole_h - h < least)] = 0
            flat = gain.reshape(wide, -1)
            best = flat.argmax(axis=1)
            for k in np.flatnonzero(flat.max(axis=1) > 1e-9):
                j, b = divmod(int(best[k]), BINS)
                if b < len(cuts[j]):
                    feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        total_g, total_h = np.bincount(node, gradient, nodes), np.bincount(node, hessian, nodes)
        value[t] = RATE * total_g / (total_h + RIDGE)
        margin += value[t, node]
    return Trees(feature, cut, value, bias)


def fit(sample: DataFrame) -> Trees:
    """Trees from `sample(text, quality)`, which must be bounded."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "x": [statistics(t) for t in batch["text"]]})

    rows = sample.mapInPandas(measure, "quality int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of the rows
    return grow(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, text_column: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the score of the whole text, from 0 to 1."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(trees.score(x))

    return docs.withColumn(name, of(F.col(f"`{text_column}`")))


def rated(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """All rows and columns of `docs(doc_id, text, ...)` with a quality score named `name`.

    Null, empty and blank texts have statistics of zero and are scored like any other. Null ids and
    labels other than 0 and 1 teach nothing; repeated rows are scored alike. Without labels, or
    with one class alone, every score is the prior. Texts are measured whole, whatever their length. A column that
    has the name already is replaced. An empty table gives an empty result.
    """
    short_batches(docs)
    return scored(docs, fit(labelled(docs, labels, "quality", 4, 2, FIT)), name=name)


@query("op4_boosted_trees")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = rated(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", predicted)
