"""Which labelled documents the lexicon of op1 is learned from."""

from __future__ import annotations

import random

import numpy as np

from millrace.llm import toxicity


def test_only_equal_sets_of_entries_count_once(spark):
    model = toxicity.CharacterModel(np.array([0]), np.array([1.0]))
    common = "that with this from have which"
    texts = [f"{common} word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    rows = [(t, i % 2) for i, t in enumerate(texts)] + [(t.upper(), i % 2) for i, t in enumerate(texts)]
    rows += [(texts[0], 1), (None, 0), ("", 0)]
    found = toxicity.distinct_rows(spark.createDataFrame(rows, "text string, toxic int"), model).collect()
    held = {(toxic, frozenset(toxicity.Holder(toxicity.Restorer(model)).entries(t))) for t, toxic in rows}
    assert len(held) == 102
    assert sorted((r.toxic, sorted(r.held)) for r in found) == sorted((t, sorted(h)) for t, h in held)


def test_the_bound_is_on_the_rows_that_are_read(spark):
    docs = [(7, f"text {i}", "x") for i in range(40)] + [(7, "text 0", "x")] * 20 + [(8, None, "x"), (8, "", "x"), (None, "text", "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, digest string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    found = [(r.text or "", r.toxic) for r in toxicity.labelled(docs, labels, "toxic", 5, 9, 100).collect()]
    assert sorted(found) == sorted([(f"text {i}", 1) for i in range(40)] + [("", 0)])
    few = [(r.text or "", r.toxic) for r in toxicity.labelled(docs, labels, "toxic", 5, 9, 10).collect()]
    assert len(few) == len(set(few)) == 10 and set(few) <= set(found)
    assert toxicity.labelled(docs, labels.limit(0), "toxic", 5, 9, 10).count() == 0


def test_wanted_entries_are_those_of_all_entries():
    rng = random.Random(5)
    pairs = [(a, b) for a in range(27) for b in range(27) if rng.random() < 0.4]
    grams = np.array([((a * 27 + b) * 27 + c) * 27 + d for a, b in pairs for c, d in rng.sample(pairs, 9)])
    model = toxicity.CharacterModel(np.unique(grams), np.ones(len(np.unique(grams))))
    words = ["idiot", "loser", "address", "ass", "eel", "hässlich", "booking", "letters", "sassy"]
    wanted = {*words, "idio-", "lett-", "häss-", "sas-"}
    every, some = (toxicity.Holder(toxicity.Restorer(model), w) for w in (None, wanted))
    for _ in range(300):
        text = ""
        for word in rng.choices(words, k=20):
            for c in word:
                signs = [s for s, letters in toxicity.LEET.items() if c in letters]
                c = rng.choice(signs) if signs and rng.random() < 0.15 else c
                text += c * rng.choice([1, 1, 1, 1, 2, 3]) + rng.choice(["", "", "", "", "-", "."])[: rng.random() < 0.2]
            text += rng.choice(["", "s", "$", "!!", "$$$", "ing", "é", "+", "."]) + rng.choice([" ", "  "])
        assert {e for e in some.entries(text) if e[-1] not in "23"} == every.entries(text) & wanted
