"""Diagonal voting against a plain version, with notices of any length."""

from __future__ import annotations

import random
import re

from millrace.llm import licenses

MIT = next(text for label, text in licenses.NOTICES if label == "mit" and len(text.split()) > 62)


def plain_spans(text, notices, size=licenses.GRAM, gap=licenses.GAP, coverage=licenses.COVERAGE):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for number, (label, notice) in enumerate(notices):
        parts = notice.split(" ")
        others = {w for name, other in notices if name != label for w in other.split(" ")}
        own = {j for j, w in enumerate(parts) if w not in others}
        hits = sorted(
            (i - j, i, j)
            for i in range(len(words) - size + 1) for j in range(len(parts) - size + 1) if words[i : i + size] == parts[j : j + size]
        )
        clusters = []
        for hit in hits:
            if not clusters or hit[0] - clusters[-1][-1][0] > gap:
                clusters.append([])
            clusters[-1].append(hit)
        for cluster in clusters:
            places = {j + k for _, _, j in cluster for k in range(size)}
            starts = [i for _, i, _ in cluster]
            if len(places) / len(parts) >= coverage and 2 * len(places & own) >= len(own):
                out.append((number, label, min(starts), max(starts) + size - 1, len(cluster), round(len(places) / len(parts), 9)))
    return out


def check(spark, texts, notices):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.spans(frame, notices).collect()
    got = [(r.doc_id, r.notice, r.label, r.first_word, r.last_word, r.votes, round(r.covered, 9)) for r in found]
    want = [(i, *span) for i, text in enumerate(texts) for span in plain_spans(text, notices)]
    assert sorted(got) == sorted(want)
    return want


def test_spans_of_disturbed_notices(spark):
    rng = random.Random(6)
    texts = [None, "", "the software", MIT.upper(), f"{MIT} {MIT}", f"before. {MIT}! after"]
    for _ in range(120):
        words = rng.choice(licenses.NOTICES)[1].split(" ")
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["odd"], [words[at], "odd"], [words[at]] * 2])
        texts.append(" ".join(rng.choices(["some", "the", "of"], k=rng.randrange(5)) + words + rng.choice(licenses.NOTICES)[1].split(" ")))
    want = check(spark, texts, licenses.NOTICES)
    assert len(want) > 100 and len({label for _, _, label, *_ in want}) > 8


def test_notices_beyond_64_words(spark):
    long = " ".join(f"w{i % 90}" for i in range(300))
    notices = [("long", long), ("other", "w1 w2 w3 x y z"), ("tiny", "a b")]
    texts = [long, " ".join(long.split()[:150]), " ".join(long.split()[40:]), "w1 w2 w3 x y z", "a b a b"]
    assert {label for _, _, label, *_ in check(spark, texts, notices)} == {"long", "other"}


def test_later_paragraphs_alone_name_the_license(spark):
    warranty = next(text for label, text in licenses.NOTICES if label == "bsd" and "contributors as is" in text)
    rows = [(1, f"Some code. {MIT}."), (2, warranty), (3, "the software is provided by nobody")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.base_labels) for r in found} == {1: ("mit", ""), 2: ("bsd", ""), 3: ("", "")}
