from __future__ import annotations

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, rules string, mix int, "
    "name string, fp long, row long, tokens long, component string, size int, shard int, words string, first int"
)
LONG = " ".join(f"word{i % 997} thing{i}" for i in range(30_000))
TEXTS = [
    None, "", "  \n\t ", "one", "One TWO three", "one two three", "the cat sat on the mat and the dog sat on the rug",
    LONG, "É ç Ü straße 你好 🙂 naïve", "a b c d e a b c d e a b c d e", "Released under the MIT License. " * 3,
    "x" * 5000, "line\nline\n\nline  \nother", "t h e  i d i o t", "-- ## ** !!", "the\x00nul\x1cfs\x85nel nbsp",
]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three"), (None, None), (3, "one"), (3, "one"), (3, "another text for this id"), (-7, "one two three")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls, empty and very long texts, ties, repeated rows, shared ids, and columns with clashing names."""
    return spark.createDataFrame(
        [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", n, 0.5, "r", 1, "n", 9, 9, 9, "c", 1, 1, "w", 1) for n, (i, t) in enumerate(edge_rows)],
        COLUMNS,
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(0, 1, 0), (4, 1, 0), (6, 0, 1), (7, 1, None), (None, 0, 1), (13, None, 1), (99, 0, 1), (3, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
