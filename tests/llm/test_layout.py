"""Packing, sharding, mixing, revisits and the pipeline against brute force."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing, packing, sharding, warc

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=40))
def test_plan_uses_every_piece_once(counts):
    histogram = np.array([0, *counts])
    used = np.zeros(len(histogram), np.int64)
    for lengths, times in packing.plan(histogram):
        assert times > 0 and sum(lengths) <= len(counts)
        used += times * np.bincount(lengths, minlength=len(histogram))
    assert (used == histogram).all()


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(10):
        a, b = rng.random((12, 30)), rng.standard_normal(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert x.min() >= 0 and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def whole_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_tokenizer():
    words = packing.WordTokenizer(TOKENIZER)
    for text in ("It's we'll DON'T, stop.", "a\tb\x1cc  d\n\ne", "É́ é ΑΣ. İstanbul ẞ ß ÿ Ÿ", "...,, a.. b,.", "½ ² 12a3 你好 🙂 K ſ", "<|endoftext|> x", "a<|endoftext|>b  <|startoftext|>.", "a <|endoftext|\n>", "É<|ENDOFTEXT|> İ<|endoftext|>"):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == whole_ids(text)[:-1], text


def check_pieces(rows, texts):
    """Every document's ids lie in exactly one piece, sequences are gapless and fit."""
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.row_id].append(r)
        sequences[r.sequence_id].append(r)
    got = Counter()
    for (doc, _), parts in found.items():
        parts.sort(key=lambda r: r.start)
        ids = [x for r in parts for x in r.ids]
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)]))[:-1]
        for r in parts:
            assert r.length == len(r.ids) and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[doc, tuple(ids)] += 1
    assert got == Counter((i, tuple(whole_ids(t))) for i, t in texts)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)]))[:-1]
        assert sum(r.length for r in parts) <= packing.WINDOW


def test_packing(spark, edge_docs, edge_rows, no_docs):
    check_pieces(packing.packed(edge_docs, TOKENIZER, keep_ids=True).collect(), edge_rows)
    assert packing.packed(no_docs, TOKENIZER).count() == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = packing.packed(docs, TOKENIZER, keep_ids=True).collect()
    check_pieces(rows, [tuple(r) for r in docs.collect()])
    tokens, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert sequences <= math.ceil(tokens / packing.WINDOW) + 1  # hardly any padding
    same = {(r.doc_id, r.start): r for r in packing.op3(spark, FOLDER).collect()}
    assert all(same[r.doc_id, r.start].ids_crc32 == r.ids_crc32 for r in rows) and len(same) == len(rows)


def check_shards(rows, texts, count=8):
    total, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(count))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = lambda t: (len(t.encode()) if t is not None else 0) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), crc(t)) for i, t in texts)
    for r in rows:
        homes[r.text_crc32, r.size].add(r.shard)
    return total, homes


def test_sharding(spark, edge_docs, edge_rows, no_docs):
    check_shards(sharding.shards(edge_docs).collect(), edge_rows)
    assert sharding.shards(no_docs).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    total, homes = check_shards(sharding.op5(spark, "/root/testdata/sf0.1").collect(), texts)
    assert max(total.values()) / min(total.values()) < 1.01
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_above_a_shard_is_cut(spark):
    texts = [(i, "the same text") for i in range(4000)] + [(i, f"other text {i}") for i in range(4000, 8000)]
    total, homes = check_shards(sharding.shards(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)
    assert max(total.values()) / min(total.values()) < 1.1
    assert max(len(h) for h in homes.values()) > 1


def test_exponent(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    frame = spark.createDataFrame([(s,) for s in shares], "share double")

    def weights(a):
        w = np.array(shares) ** a
        return w / w.sum()

    a = mixing.exponent_for(frame, entropy=1.2)
    w = weights(a)
    assert -(w * np.log(w)).sum() == pytest.approx(1.2, abs=1e-6)
    a = mixing.exponent_for(frame, repetitions=3.0)
    ratio = weights(a) / shares
    assert ratio.max() / ratio.min() == pytest.approx(3.0, abs=1e-6)
    assert mixing.exponent_for(frame, entropy=9.0) == 0 and mixing.exponent_for(frame, repetitions=100.0) == 0


def check_mix(rows, texts, limit):
    """Uses per document differ by one at most within a source, and spend the budget of its weight."""
    tokens, uses = defaultdict(int), defaultdict(Counter)
    size = lambda t: max(1, len((t or "").encode().split()))
    for n, (_, source, text) in enumerate(texts):
        tokens[source] += size(text)
    used = Counter()
    for r in rows:
        uses[r.source][r.doc_id, r.text] += 1
        used[r.source] += r.mix.tokens
        assert r.mix.tokens == size(r.text) and 0 <= r.mix.rank < 1
    longest = max(size(t) for _, _, t in texts)
    copies = Counter((s, i, t) for i, s, t in texts)
    weight = {r.source: r.mix.weight for r in rows}
    least = min(weight[s] / tokens[s] for s in tokens)
    for s in tokens:
        passes = weight[s] / tokens[s] / least
        assert passes <= limit + 1e-6
        counts = [n / copies[s, *key] for key, n in uses[s].items()]
        assert set(counts) <= {math.floor(passes + 1e-9), math.ceil(passes - 1e-9)}
        assert abs(used[s] - passes * tokens[s]) <= longest * max(copies.values()) + 1e-6
    assert {k for c in uses.values() for k in c} == {(i, t) for i, _, t in texts}


def test_mixing(spark, edge_docs, no_docs):
    texts = [(r.doc_id, r.source, r.text) for r in edge_docs.collect()]
    found = mixing.mixed(edge_docs, repetitions=2.0)
    assert [c for c in found.columns if c != "mix"] == [c for c in edge_docs.columns if c != "mix"]
    check_mix(found.collect(), texts, 2.0)
    assert mixing.mixed(no_docs).count() == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_mix(mixing.mixed(docs).collect(), [(r.doc_id, r.source, r.text) for r in docs.collect()], mixing.REPETITIONS)
    half = mixing.mixed(docs, repetitions=None, budget=10_000.0).collect()
    assert 8_000 < sum(r.mix.tokens for r in half) < 60_000 and max(r.mix.epoch for r in half) == 0


def test_revisits_match_sql(spark):
    result = compare(spark, warc.op8, warc.ORACLE, "/root/testdata/sf0.01")
    assert result["equal"], result["diff"]
    assert "CartesianProduct" not in result["plan"] and "Python" not in result["plan"]


START = datetime(2024, 1, 1)
CAPTURES = [
    (1, "response", "http://www.a.org/x/?utm_source=q#top", 0, "d1", {"ETag": '"v1"', "Content-Type": "text/html", "Age": "1"}),
    (2, "response", "https://A.org:443/x", 60, "d2", {"etag": 'W/"v2"', "Last-Modified": "m2"}),
    (3, "revisit", "http://a.org/x", 60, None, {"ETag": '"v1"', "Content-Type": "text/plain", "Age": "7", "X": "new"}),
    (4, "revisit", "http://a.org/x", 9000, None, {"ETag": '"v2"', "content-length": "0"}),
    (5, "revisit", "http://a.org/x", 9001, None, {"Etag": '"v3"', "Last-Modified": "m2"}),
    (6, "revisit", "http://a.org/x", 9002, None, {"Last-Modified": "m2"}),
    (7, "revisit", "http://a.org/x", 9003, "d2", None),
    (8, "revisit", "http://a.org/x", 9004, None, {"Age": "1"}),
    (9, "revisit", "http://b.org/", 9004, "d2", {}),
    (10, "revisit", None, 9004, "d2", {}),
    (11, "revisit", "http://a.org/x", None, "d2", {}),
    (12, "request", "http://a.org/x", 9004, "d2", {}),
    (13, "response", "http://a.org/x", 60, "d0", {"ETag": '"v2"', "Last-Modified": "m2"}),
    (3, "revisit", "http://a.org/x", 60, None, {"ETag": '"v1"', "Content-Type": "text/plain", "Age": "7", "X": "new"}),
]


def test_revisits(spark):
    rows = [(i, k, u, None if t is None else START + timedelta(seconds=t), d, h, "extra") for i, k, u, t, d, h in CAPTURES]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, captured timestamp, digest string, headers map<string,string>, slab string")
    for slab in (3600, 1, 10**9):
        found = sorted(((r.record_id, r.outcome, r.target_id) for r in warc.resolve(frame, slab).collect()), key=str)
        assert found == sorted([
            (3, "resolved", 1), (3, "resolved", 1), (4, "resolved", 13), (5, "mismatch", 13), (6, "resolved", 13),
            (7, "mismatch", 13), (8, "unverified", 13), (9, "unresolved", None), (10, "unresolved", None), (11, "unresolved", None),
        ], key=str)
    headers = {r.record_id: r.headers for r in warc.resolve(frame).collect()}
    assert headers[3] == {"etag": '"v1"', "content-type": "text/html", "age": "7", "x": "new"}
    assert headers[4] == {"etag": '"v2"', "last-modified": "m2"} and headers[5] is None
    assert warc.resolve(frame.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.org", "x"), (1, "http://a.org", "")], "page_id long, url string, html string")
    assert warc.resolve(warc.captures(pages)).count() == 9


def test_canonical_url(spark):
    rows = ["HTTP://WWW.A.org:80/B/?ref=1&q=2&utm_x=3#f", "a.org", "https://a.org/?gclid=1", "", None]
    found = spark.createDataFrame([(r,) for r in rows], "url string").select(warc.canonical_url(warc.F.col("url"))).collect()
    assert [r[0] for r in found] == ["a.org/B?q=2", "a.org", "a.org", "", None]


def plain_survivors(rows):
    """Smallest ids of the groups that links of a Jaccard similarity of 0.8 over five-word shingles make."""
    held = {}
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", w) if x]
        held[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in held}
    for i in sorted(held):
        for j in held:
            a, b = held[i], held[j]
            if i < j and (len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_pipeline(spark):
    import corpus_pipeline

    from millrace.llm import quality_rules, toxicity
    from millrace.llm.common import materialise

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "mixing", "packing"]
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        stages.append(materialise(stage(spark, stages[-1] if stages else docs, FOLDER), "test"))
    for frame in stages[:-1]:
        assert frame.columns == docs.columns
    ids = [{r.doc_id for r in f.collect()} for f in stages]
    scores = toxicity.rated(docs, labels, "rated").collect()
    assert ids[0] == {r.doc_id for r in scores if r.rated < 0.5}
    trusted = quality_rules.trusted_documents(labels)
    rules = quality_rules.rated(stages[0], trusted, evidence=quality_rules.EVIDENCE).collect()
    assert ids[1] == {r.doc_id for r in rules if r.rules.kept} and stages[1].count() == len(ids[1])
    assert ids[2] == plain_survivors(stages[1].collect()) and stages[2].count() == len(ids[2])
    assert ids[3] == ids[2] and ids[4] == ids[2]
    uses = Counter(r.doc_id for r in stages[3].collect())
    assert max(uses.values()) <= math.ceil(corpus_pipeline.REPETITIONS)
    assert Counter(r.doc_id for r in stages[4].where("start = 0").collect()) == uses
    run = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, run.select(*key).collect())) == Counter(map(tuple, stages[4].select(*key).collect()))
