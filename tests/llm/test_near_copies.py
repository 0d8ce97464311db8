"""The pipeline's near-duplicate stage against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
from test_duplicates import union_find

from millrace.llm import near_copies


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows):
    """The smallest id of each row's group, by comparing all pairs."""
    sets = {i: plain_shingles(t) for i, t in rows}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return union_find(sets, [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])])


def edited_texts(seed=5):
    """Texts of 10 to 400 words, each with copies in which one to eight words are changed."""
    rng, out = random.Random(seed), []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([10, 40, 150, 250, 400]))]
        out.append(" ".join(words))
        for changes in (0, 1, 2, 3, 4, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = f"x{rng.randrange(5000)}"
            out.append(" ".join(copy).upper() if changes == 0 else "\n".join(copy))
    return list(enumerate(out))


def test_stage_keeps_one_of_each_group(spark):
    rows = edited_texts()
    expected = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == expected
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(expected.values()))


def test_cut_shards_keep_every_link(spark):
    rows = edited_texts(6)
    keyed = [(bytearray(str(i).zfill(4).encode()), t) for i, t in rows]
    texts = spark.createDataFrame(keyed, "key binary, text string")
    edges = [(int(bytes(r.a)), int(bytes(r.b))) for r in near_copies.links(texts, capacity=2).collect()]
    assert union_find([i for i, _ in rows], edges) == plain_groups(rows)


def test_one_large_group_gives_few_links(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(str(i).encode(), " ".join([*words, f"own{i}"])) for i in range(300)]
    found = near_copies.links(spark.createDataFrame([(bytearray(k), t) for k, t in rows], "key binary, text string"))
    assert 299 <= found.count() <= 299 * near_copies.BANDS


def test_leaders_lose_no_link():
    """Sets that drift away from each other, so that many are near a follower and not near its leader."""
    rng = random.Random(3)
    for _ in range(40):
        sets = []
        for _ in range(60):
            own = set(rng.choice(sets)) if sets and rng.random() < 0.9 else set(rng.sample(range(10_000), 50))
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.randrange(10_000))
            sets.append(own)
        near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
        pairs = [(i, j) for i in range(60) for j in range(i) if near(sets[i], sets[j])]
        for guests in (0, 20):
            tree = near_copies.Leaders(64, near_copies.SIMILARITY)
            held = [np.array(sorted(s), np.uint64) for s in sets]
            met = [(i, int(k)) for i, h in enumerate(held) for k in tree.meet(str(i).encode(), near_copies.fingerprint(h), h, i < 60 - guests)]
            assert all(near(sets[i], sets[j]) for i, j in met)
            seen = [(i, j) for i, j in pairs if j < 60 - guests]
            assert union_find(range(60), met) == union_find(range(60), seen)
        assert len(tree.tree.values) < 60


def test_a_large_group_costs_one_comparison_a_text(monkeypatch):
    calls, plain = [0], near_copies.similarity

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)

    monkeypatch.setattr(near_copies, "similarity", counted)
    rng, base = np.random.default_rng(1), np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tree = near_copies.Leaders(near_copies.RADIUS, near_copies.SIMILARITY)
    for i in range(2000):
        held = np.unique(np.concatenate([np.delete(base, rng.integers(0, 1000, 40)), np.array([i], np.uint64)]))
        tree.meet(str(i).encode(), near_copies.fingerprint(held), held, True)
    assert calls[0] < 2 * 2000 and len(tree.tree.values) < 10


def test_edges(spark, edge_docs, no_docs):
    kept = near_copies.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert -7 in ids and 4 not in ids and 5 not in ids and ids.count(0) == 1 and 1 not in ids and 2 not in ids
    assert near_copies.keep_one(no_docs).count() == 0 and near_copies.near_copies(edge_docs).count() == edge_docs.count()
