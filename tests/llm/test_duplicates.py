"""SimHash, embeddings and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from millrace.llm import embeddings, simhash
from millrace.llm.components import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a long path
    edges += [(5000, 5001 + i) for i in range(300)] + [(5000, 5000)]  # a star with a loop
    frame = spark.createDataFrame([*edges, *edges[:50], (None, 3), (4, None)], "a long, b long")
    found = {r.node: r.component for r in components(frame).collect()}
    expected = union_find({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: expected[n] for n in linked}
    assert components(frame.limit(0)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    values = sorted({f for _, f in prints})
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    group = union_find(values, near)
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return [(i, f, least.get(group[f])) for i, f in prints]


def test_simhash_edges(spark, edge_docs, edge_rows, no_docs):
    found = simhash.near_duplicates(edge_docs)
    got = [(r[0], r[1] & (2**64 - 1), r[2]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(plain_components(edge_rows), key=str)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert -7 in ids and 4 not in ids and 5 not in ids and ids.count(3) == 2  # two texts, one of them repeated
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids
    assert simhash.keep_one(no_docs).count() == 0


def test_simhash_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {(r[0], r[1], r[2]) for r in simhash.op9(spark, folder).collect()}
    assert found == {(i, f"{f:016x}", c) for i, f, c in plain_components(rows)}


def test_every_link_is_kept_when_shards_are_cut(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    values |= {0xABC << 52 | rng.getrandbits(12) for _ in range(150)}  # one hot block value
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    for capacity in (4096, 10):
        edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, capacity=capacity).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        every = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
        assert union_find(values, edges) == union_find(values, every)


def test_bk_tree():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    assert tree.within(5, 2) == []
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def vectors():
    rng = np.random.default_rng(5)
    rows = [rng.standard_normal(16) for _ in range(60)]
    for center in rows[:6]:
        rows += [center + 0.1 * rng.standard_normal(16) for _ in range(12)]
    rows += [rows[0].copy() for _ in range(9)] + [rows[1] * 3]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    n = len(out)
    return out + [
        (n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, [float("nan")] * 16),
        (n + 5, [float("inf")] + [0.0] * 15), (n + 6, out[0][1][:8]), (None, out[0][1]), (2, out[2][1]),
    ]


def plain_links(rows, threshold):
    sound = [
        (k, i, np.array(v)) for k, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    count, edges = dict.fromkeys(range(len(rows)), 0), []
    for k, i, v in sound:
        for m, j, w in sound:
            if k != m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                count[k] += 1
                edges.append((i, j))
    group = union_find({i for _, i, _ in sound}, edges)
    return sorted(((i, count[k], group.get(i, i), i is not None) for k, (i, _) in enumerate(rows)), key=str), group


def test_embeddings(spark):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, links string, vector int")
    expected, group = plain_links(rows, 0.9)
    expected = sorted(((i, n, c, i is not None and i == c) for i, n, c, _ in expected), key=str)
    for options in ({}, {"bucket": 8, "recall": 0.99999}, {"bucket": 8, "recall": 0.99999, "block": 5}):
        found = embeddings.near_duplicates(frame, **options)
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected, options
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_any_magnitude(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [2.0, -1.0]), (4, [3e-320, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_embeddings_query(spark):
    folder = "/root/testdata/sf0.001"
    found = embeddings.op2(spark, folder)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected, _ = plain_links([(r[0], [float(x) for x in r[1]]) for r in rows], 0.9)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == sorted(e[:3] for e in expected)
    assert found.where("kept <> (vec_id = component_id)").count() == 0


def test_tables_and_bits():
    assert embeddings.tables_and_bits(0, 0.9, 0.999, 256) == (1, 0)
    count, bits = embeddings.tables_and_bits(10**6, 0.9, 0.999, 256)
    assert bits == 12 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** count <= 0.001


def test_plans_have_no_cross_join(spark):
    plan = simhash.op9(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
