"""Toxicity, quality, licenses against brute force."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, quality_classifier, quality_rules, toxicity

FOLDER = "/root/testdata/sf0.1"


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def model(spark):
    grams = toxicity.character_counts(table(spark, "documents", "/root/testdata/sf0.01")).toPandas()
    return toxicity.CharacterModel(grams["gram"].to_numpy(), grams["n"].to_numpy(float))


def test_character_counts(spark, no_docs):
    frame = spark.createDataFrame([("ab",), (None,), ("É1",)], "text string")
    found = {r.gram: r.n for r in toxicity.character_counts(frame).collect()}
    expected = Counter()
    for symbols in ([1, 2], [], [5, 0]):
        padded = [0, 0, 0, *symbols, 0]
        for i in range(len(padded) - 3):
            a, b, c, d = padded[i : i + 4]
            expected[((a * 27 + b) * 27 + c) * 27 + d] += 1
    assert found == dict(expected)
    assert toxicity.character_counts(no_docs).count() == 0


def test_viterbi_finds_the_best_reading(model):
    codes = toxicity._codes()
    for text in ("1d10t", "l-o-ser", "stt00p", "a|b", "$c!"):
        steps = toxicity.lattice(text, codes)

        def cost(choice):
            state, score = (0, 0, 0), -sum(c for _, c in choice)
            for y in [y for symbols, _ in choice for y in symbols] + [0]:
                if y or state[2]:
                    score += float(model.log[(*state, y)])
                    state = (*state[1:], y)
            return score, state

        best = max(cost(c)[0] for c in itertools.product(*steps))
        found = model.decode(steps)
        reached = [c for c in itertools.product(*steps) if abs(cost(c)[0] - best) < 1e-4]
        plain = lambda ys: "".join(chr(96 + y) if y else " " for y in ys).split()
        assert plain(found) in [plain([y for s, _ in c for y in s]) for c in reached]


def test_restored_words(model):
    read = toxicity.Restorer(model)
    assert read.word("the***") == ("the",) and read.word("555-6503") == () and read.word("hello") == ("hello",)
    assert read.word("m0r0n") == ("moron",) and read.word("i.d.i.o.t") == ("idiot",)
    assert read.text("You are an I D I O T, l00000ser") == "you are an idiot loser"
    assert read.word("loooooser") == ("loser",)
    assert "".join(read.word("-".join("the" * 40))) == "the" * 40
    for raw in ("1d1075", "!d!0t", "iiddiioott", "i---d---i---o---t", "idiot!!!", "idi0t$$$"):
        assert read.word(raw)[0].startswith("idiot"), raw
    assert read.word("stuupid") == ("stupid",) and read.word("|oser") == ("loser",)
    assert read.text("i  d  i  o  t") == read.text("i\nd i  o t") == "idiot"
    for plain in ("good", "all", "касса", "café"):
        assert read.word(plain) == (plain,)
    assert read.word("2019") == read.word("$100") == read.word("+-") == () and read.word("the$$$") == ("the",)
    assert read.word("你好1") == ("你好",)


def test_words_with_one_pair_are_read_as_by_the_lattice(model):
    read, rng = toxicity.Restorer(model), np.random.default_rng(4)
    letters, both = "etaoinshr", set()
    for _ in range(1000):
        word = "".join(rng.choice(list(letters), rng.integers(2, 9)))
        at = int(rng.integers(0, len(word)))
        word = word[:at] + word[at] + word[at:]
        (found,) = read.read(word)
        assert read.word(word) == (found,)
        both.add(found == word)
    assert both == {True, False}


def test_the_model_weighs_edge_signs(spark):
    text = "what an ass he is a dumbass and an asshole who talks shit " * 50 + "the cat sat on a mat " * 20
    grams = toxicity.character_counts(spark.createDataFrame([(text,)], "text string")).toPandas()
    read = toxicity.Restorer(toxicity.CharacterModel(grams["gram"].to_numpy(), grams["n"].to_numpy(float)))
    assert read.word("dumba$$") == ("dumbass",) and read.word("a$$") == ("ass",) and read.word("455h013") == ("asshole",)
    assert read.word("s---h---i---t") == ("shit",) and read.word("the$$$") == ("the",) and read.word("cat$") == ("cat",)


def test_toxicity_edges(spark, edge_docs, edge_labels, no_docs):
    found = toxicity.rated(edge_docs, edge_labels, "rated")
    assert found.columns == [*edge_docs.columns, "rated"] and found.count() == edge_docs.count()
    assert found.where("rated is null or rated < 0 or rated > 1").count() == 0
    blank = {r.rated for r in found.where("text is null or trim(text) = ''").collect()}
    assert len(blank) == 1
    named = toxicity.rated(edge_docs, edge_labels)
    assert sorted(named.columns) == sorted(edge_docs.columns) and named.where("score is null").count() == 0
    assert toxicity.rated(no_docs, edge_labels, "rated").count() == 0
    alone = toxicity.rated(edge_docs, edge_labels.limit(0), "rated")
    assert alone.where("rated > 0.5").count() == 0


def held_out_accuracy(found, labels, column):
    joined = found.where("held_out").join(labels, "doc_id").where(f"{column} is not null")
    return joined.agg(F.avg((F.col("predicted") == F.col(column)).cast("double")), F.count("*")).first()


def test_toxicity_held_out(spark):
    found = toxicity.op1(spark, FOLDER)
    share, n = held_out_accuracy(found, table(spark, "labels"), "toxic")
    assert n > 500 and share > 0.97
    assert found.count() == table(spark, "documents").count()


def test_deobfuscated_text_scores_as_the_plain_one(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    model, lexicon = toxicity.learn(docs, labels)
    words = [w for w in lexicon.weights if w.isascii() and w.isalpha()]
    assert len(words) >= 5
    clean = "the of and to that with this "
    rows = [(clean * 3,)] + [(clean + f(w) + " " + clean + f(v),) for w, v in zip(words, words[1:], strict=False) for f in (
        str, str.upper, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: ".".join(w), lambda w: w[0] + w[1] * 4 + w[2:])]
    found = [r.score for r in toxicity.scored(spark.createDataFrame(rows, "text string"), model, lexicon).collect()]
    assert found[0] < 0.5 and np.mean([s >= 0.5 for s in found[1:]]) > 0.9


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(*(words[i:] for i in range(5)), strict=False))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check_rules(rows):
    for r in rows:
        counts = plain_rules(r.text)
        assert tuple(r.rules[n] for n in NAMES) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r.rules.base_failed == failed
        assert r.rules.kept == (not failed and r.rules.score >= quality_rules.THRESHOLD)


def test_quality_rules_edges(spark, edge_docs, edge_labels, no_docs):
    trusted = quality_rules.trusted_documents(edge_labels)
    found = quality_rules.rated(edge_docs, trusted)
    assert found.count() == edge_docs.count()
    check_rules(found.collect())
    assert quality_rules.rated(no_docs, trusted).count() == 0
    check_rules(quality_rules.rated(edge_docs, trusted.limit(0)).collect())


def test_quality_rules_keep_the_clean(spark):
    found = quality_rules.op7(spark, FOLDER).join(table(spark, "labels"), "doc_id").where("not base_failed")
    rows = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert rows.get((1, False), 0) <= 0.005 * rows[1, True] and rows.get((0, True), 0) <= 0.05 * rows[0, False]


def test_native_plans(spark):
    for query in (quality_rules.op7, licenses.op10):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        for unwanted in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert unwanted not in plan


def plain_words(low):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_licenses(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words, places, labels = plain_words(low), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check_licenses(found, rows):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(got, key=str) == sorted(((i, *plain_licenses(t)) for i, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(f"{r.labels},".split(",")) for r in found)


def test_licenses_edges(spark, edge_docs, edge_rows, no_docs):
    check_licenses(licenses.scan(edge_docs).collect(), edge_rows)
    assert licenses.scan(no_docs).count() == 0


def test_license_spans(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the really strict terms of the GNU General Public License."
    rows = [
        (1, gpl), (2, "intro words " + gpl + " end"), (3, "Licensed under the GNU Lesser General Public License"),
        (4, "licensed under the sun and the moon"), (5, "İ APACHE-LICENSE K mit\nlicense"), (6, None), (7, "Licensed under CC BY-NC 4.0."),
        (None, "Released under the MIT License"), (None, "nothing"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(frame).collect()
    check_licenses(found, rows)
    labels = {(r.doc_id, r.n_words if r.doc_id is None else 0): r.labels for r in found}
    assert labels[1, 0] == "gpl" and labels[2, 0] == "gpl" and labels[3, 0] == "gpl,lgpl" and labels[4, 0] == ""
    assert labels[7, 0] == "cc-by-nc" and labels[None, 5] == "mit" and labels[None, 1] == ""
    spans = {(r.doc_id, r.label): (r.first_word, r.last_word) for r in licenses.spans(frame).collect()}
    assert spans[2, "gpl"] == (2, len(plain_words(gpl)) + 1)


def test_statistics_and_trees(spark):
    assert quality_classifier.statistics(None) == quality_classifier.statistics(" \n") == [0.0] * len(quality_classifier.FEATURES)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = quality_classifier.grow(x, y)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        out = trees.bias
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            while 2 * node + 1 < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            out += value[node]
        return out

    assert np.allclose(trees.margin(x[:50]), [walk(r) for r in x[:50]])
    one = quality_classifier.grow(x, np.ones(2000))
    assert one.score(x).min() > 0.99
    assert quality_classifier.grow(x[:0], y[:0]).score(x).max() == 0.5


def test_classifier_edges(spark, edge_docs, edge_labels, no_docs):
    found = quality_classifier.rated(edge_docs, edge_labels, "rated")
    assert found.count() == edge_docs.count() and found.where("rated is null").count() == 0
    named = quality_classifier.rated(edge_docs, edge_labels)
    assert sorted(named.columns) == sorted(edge_docs.columns) and named.where("score is null").count() == 0
    assert quality_classifier.rated(no_docs, edge_labels, "rated").count() == 0
    assert quality_classifier.rated(edge_docs, edge_labels.limit(0), "rated").where("rated <> 0.5").count() == 0


def test_classifier_held_out(spark):
    share, n = held_out_accuracy(quality_classifier.op4(spark, FOLDER), table(spark, "labels"), "quality")
    assert n > 500 and share > 0.97
