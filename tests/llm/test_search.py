"""Exact top-k search, ranked lexical search and whitening against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import exact_search, lexical_search, whitening

VECTORS = "vec_id long, embedding array<double>, score double, cell int, n string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 7, "n") for i, v in rows], VECTORS)


def plain_top(rows, k, every, scale=64.0):
    """Every query against every row, in whole numbers of any size."""
    held = []
    for number, (i, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            held.append((number, i, [math.floor(scale * c) for c in v]))
    out = []
    for number, i, q in held:
        if i is None or i % every:
            continue
        found = [(-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0) for m, j, x in held if m != number and len(x) == len(q)]
        for rank, (score, none, j) in enumerate(sorted(found)[:k], 1):
            out.append((i, rank, None if none else j, -score))
    return sorted(out, key=str)


def mixed_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0, 0.0, -0.0]) for i in range(120)]  # a hot vector
    rows += [(20, [1.0] * 6), (20, [1.0] * 6), (40, [1.0] * 6), (None, [1.0] * 6), (None, [9.0] * 6)]
    rows += [(60, None), (80, [1.0, None] * 3), (100, [math.nan] * 6), (120, [math.inf] * 6), (140, [0.0] * 6)]
    rows += [(160, [1.0, 2.0]), (161, [0.5, -2.0]), (180, []), (181, []), (200, [3.0]), (-20, [-1.0] * 6)]
    return rows


@pytest.mark.parametrize("capacity", [16, 4096])
def test_top_k(spark, capacity):
    rows = mixed_vectors()
    found = exact_search.top_k(vector_table(spark, rows), k=5, capacity=capacity)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(rows, 5, 20)


def test_top_k_of_large_numbers(spark):
    """Products beyond what doubles hold exactly; an empty table."""
    rows = [(i, [float((i * 7919 + 104729) % 2**27) * 3, float(i), -1.0]) for i in range(100)]
    found = exact_search.top_k(vector_table(spark, rows), k=4, capacity=32).collect()
    assert sorted(map(tuple, found), key=str) == plain_top(rows, 4, 20)
    assert exact_search.top_k(vector_table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 9))
def test_tree_misses_nothing(points, count, leaf):
    points = np.array(points, float)
    tree, ids = exact_search.KDTree(points, leaf), np.arange(len(points))[::-1].copy()
    for (start, end), low, high in zip(tree.spans, tree.low, tree.high, strict=True):
        held = tree.points[start:end]
        assert (held.min(axis=0) == low).all() and (held.max(axis=0) == high).all()
    asked = points[:5]
    score, place = tree.search(asked, np.full(len(asked), -np.inf), ids, count)
    for row, q in enumerate(asked):
        want = sorted(((-(q @ x), ids[j]) for j, x in enumerate(points)))[:count]
        assert [(-score[row, c], ids[place[row, c]]) for c in range(len(want))] == want
        assert (place[row, len(want) :] == -1).all()


def plain_ranks(docs, items, top=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(term(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for row, (i, c) in enumerate(counts):
            m = 25 + 75 * c.total() * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in term(text) if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, row))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_size", "block", "owners"), [(3, 2, 3), (4096, 256, 4), (7, 5, 1)])
def test_ranks(spark, edge_docs, edge_rows, no_docs, monkeypatch, slice_size, block, owners):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SLICE", slice_size)
    texts = ["One two", "the CAT and the dog the", "straße Ü É", "", None, "word5 thing7 thing29999", "license released mit", "nothing-of-this", "two"]
    items = [*enumerate(texts), (None, "one three"), (3, "one"), (3, "one")]
    more = [(500 + i, "common words here and rare%d x%d" % (i % 7, i)) for i in range(60)] + [(900 + i, "common copy") for i in range(40)]
    items += [(77, "common rare3 x5 words copy here")]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, "s", 3) for i, t in items], "item_id long, text string, rank int, slice string, doc_id long")
    found = lexical_search.ranked(docs, asked, owners=owners)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_ranks([*edge_rows, *more], items)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) > 50
    if owners == 1:
        assert lexical_search.ranked(no_docs, asked).count() == 0 and lexical_search.ranked(docs, asked.limit(0)).count() == 0


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    given_rows = [(i, (rng.standard_normal(12) * np.linspace(3, 0.2, 12) + 5).tolist()) for i in range(400)]
    given_rows += [(1, given_rows[7][1]), (None, given_rows[8][1]), (2000, given_rows[9][1])] * 40
    dropped = [(5, None), (6, []), (7, [1.0] * 11 + [None]), (8, [1.0] * 11 + [math.nan]), (9, [math.inf] * 12), (10, [1.0, 2.0]), (11, [1e300] * 12)]
    frame = whitening.whitened(vector_table(spark, [*given_rows, *dropped]))
    assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = frame.collect()
    x = np.floor(256 * np.array([v for _, v in given_rows]))
    fit, values, vectors = plain_whitening(x)
    assert len(found) == 4 * len(given_rows) and {r.n for r in found} == {len(fit)}
    by = Counter()
    sums = fit.sum(axis=0).astype(int).tolist()
    plain = [(x[k] - fit.mean(axis=0)) @ vectors[:, :4] / np.sqrt(values[:4]) for k in range(len(x))]
    want = {}
    for (i, _), row, z in zip(given_rows, x.astype(int).tolist(), plain, strict=True):
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        for c in range(4):
            want.setdefault((i, c + 1), []).append((deviation, abs(z[c])))
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, abs(r.whitened)))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        by[r.component] += 1
    assert got.keys() == want.keys()
    for key, pairs in want.items():
        for (d, z), (e, y) in zip(sorted(pairs), sorted(got[key]), strict=True):
            assert d == e and z == pytest.approx(y, abs=1e-8)
    assert whitening.whitened(vector_table(spark, dropped[:4])).count() == 0
    assert whitening.whitened(vector_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


@pytest.mark.parametrize(("sides", "components"), [([4, 4, 4, 2, 2], 4), ([3, 0, 0], 1), ([5, 5, 5, 5, 5], 4), ([6, 2], 2)])
def test_repeated_and_missing_eigenvalues(spark, sides, components):
    """Points on the axes, so the eigenvalues are known: 2 side² / n each."""
    size = len(sides)
    points = [[s * sign * float(k == d) for k in range(size)] for d, s in enumerate(sides) for sign in (1, -1)]
    rows = whitening.whitened(vector_table(spark, list(enumerate(points))), scale=1.0).collect()
    distinct = len({tuple(p) for p in points})
    share = sorted((s * s / sum(t * t for t in sides) for s in sides), reverse=True)
    assert {r.component for r in rows} == set(range(1, components + 1)) and {r.n for r in rows} == {distinct}
    for r in rows:
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    z = {}
    for r in rows:
        z.setdefault(r.component, []).append(r.whitened)
    unique = {tuple(p): k for k, p in enumerate(points)}
    kept = np.array([[z[c][k] for c in sorted(z)] for k in unique.values()])
    assert np.abs(kept.T @ kept / distinct - np.eye(components)).max() < 1e-9


def test_deviation_beyond_64_bits():
    x = np.array([[2**40, 0], [0, 1]])
    assert whitening.deviations(x, 2**20, [0, 0], 2**40) == [None, 2**40]
    assert whitening.deviations(x[1:], 3, [1, 1], 1) == [1 + 4]
