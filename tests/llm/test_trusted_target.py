"""The evidence-weighed ratio of op7 on documents whose labels are left out of the target."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_rules


def tables(spark, size):
    return [spark.read.parquet(f"/root/testdata/{size}/{name}.parquet") for name in ("documents", "labels")]


@pytest.mark.parametrize(("size", "folds"), [("sf0.001", 5), ("sf0.01", 5), ("sf0.1", 1)])
def test_left_out_good_documents_stay(spark, size, folds):
    docs, labels = tables(spark, size)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    seen = Counter()
    for k in range(folds):
        trusted = quality_rules.trusted_documents(labels.where(fold != k))
        found = quality_rules.rated(docs.select("doc_id", "text"), trusted)
        judged = found.join(labels, "doc_id").where("not rules.base_failed").where((F.col("quality") == 0) | (fold == k))
        for r in judged.groupBy("quality", "rules.kept").count().collect():
            seen[r.quality, r.kept] += r["count"]
    print(size, dict(seen))
    assert seen[1, True] > 50 and seen[1, False] <= 0.01 * seen[1, True]
    assert seen[0, False] > seen[0, True]


def plain_grams(spark, docs):
    """The buckets of every document's words and pairs, by Spark's hash."""
    both = quality_rules.hashes(quality_rules.words(F.col("text")), lambda h, pairs: F.concat(h, pairs))
    hashes = docs.select("doc_id", F.transform(both, lambda x: quality_rules.bucket(x, quality_rules.BUCKETS)).alias("g"))
    return {r.doc_id: Counter(r.g) for r in hashes.collect()}


def test_weighed_scores(spark, edge_docs, edge_labels, no_docs):
    """The score against counts in plain Python; a target without documents gives 0."""
    docs, labels = tables(spark, "sf0.001")
    found = quality_rules.rated(docs, quality_rules.trusted_documents(labels))
    assert found.columns == [*docs.columns, "rules"]
    grams = plain_grams(spark, docs)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.FOLDS)).alias("fold")
    folds = {r.doc_id: r.fold for r in docs.select("doc_id", fold).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = ([Counter() for _ in range(quality_rules.FOLDS)] for _ in range(2))
    for i, g in grams.items():
        for k in set(range(quality_rules.FOLDS)) - {folds[i]}:
            raw[k].update(g)
            target[k].update(g if i in good else {})
    assert len(set(folds.values())) == quality_rules.FOLDS
    for r in found.collect():
        g, t, c = grams[r.doc_id], target[folds[r.doc_id]], raw[folds[r.doc_id]]
        rate = t.total() / c.total()
        total = sum(n * np.log((t[b] + 5) / (rate * c[b] + 5)) for b, n in g.items())
        assert r.rules.score == pytest.approx(total / max(1, g.total()), abs=1e-6)
        assert r.rules.kept == (not r.rules.base_failed and r.rules.score >= quality_rules.THRESHOLD)
    edges = quality_rules.rated(edge_docs, quality_rules.trusted_documents(edge_labels.limit(0)))
    assert edges.count() == edge_docs.count() and {r.rules.score for r in edges.collect()} == {0.0}
    assert quality_rules.rated(no_docs, quality_rules.trusted_documents(edge_labels)).count() == 0


def test_ids_beyond_the_broadcast(spark, edge_docs, edge_labels, monkeypatch):
    """More trusted ids than are broadcast give the same rows by a shuffle."""
    trusted = quality_rules.trusted_documents(edge_labels)
    rows = [sorted(map(repr, quality_rules.rated(edge_docs, trusted).collect()))]
    monkeypatch.setattr(quality_rules, "BROADCAST", 1)
    rows.append(sorted(map(repr, quality_rules.rated(edge_docs, trusted).collect())))
    assert rows[0] == rows[1]


def test_ratios_have_a_fixed_size(spark):
    """What is broadcast to the documents is one array per fold."""
    docs, labels = tables(spark, "sf0.001")
    marked = quality_rules.with_folds(docs, quality_rules.trusted_documents(labels), "doc_id", "fold", "good", 5)
    rows = quality_rules.ratios(marked, "text", "fold", "good", 1 << 16, 5, 5.0).collect()
    assert [r.fold for r in rows] == list(range(5)) and {len(r.ratio) for r in rows} == {1 << 16}
