"""License scans by diagonal voting over word k-grams.

The hashes of all rolling word k-grams of all documents are joined to those of the license notices
below, whose number is fixed; hashes that no notice has are left out while they are still in the row. A hit at
word i of the document and word j of a notice votes for the diagonal i - j. Votes are counted per
document, notice and diagonal; diagonals that are at most `gap` apart are merged, since a word put in or
left out shifts the rest. Every hit's words are compared with the notice's, and a span counts if its hits cover
`coverage` of the notice's words, each counted once, and at least half of the words that no notice of another
license has, such as `lesser`. Notices have any length. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import let, query, table

GRAM = 3
GAP = 2
COVERAGE = 0.8

# Phrases that name a license wherever their words stand in a row.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Common notices, as lower-case words; the paragraphs of longer texts one by one.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null.

    `lower` also changes letters beyond ASCII, which no phrase or notice has. Only two of them turn
    into ASCII letters; texts with those are lower-cased letter by letter.
    """
    whole = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = F.when(whole.rlike("[İK]"), F.translate(whole, upper, upper.lower())).otherwise(F.lower(whole))
    return F.filter(F.split(small, BREAK), lambda w: w != "")


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts of a phrase's words in a row."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(w, i + k) == part)
        return F.coalesce(found, F.lit(False))

    none = F.array().cast("array<int>")
    starts = F.when(F.size(w) >= len(parts), F.sequence(F.lit(0), F.size(w) - len(parts))).otherwise(none)
    return F.when(F.array_contains(w, parts[-1]), F.filter(starts, here)).otherwise(none)


def base(w: Column) -> Column:
    """Struct of the phrase counts of a text with words `w`."""

    def summed(places: Column) -> Column:
        one = [F.when(F.size(places[label]) > 0, F.lit(label)) for _, label in PHRASES]
        return let(
            F.concat(*[places[label] for _, label in PHRASES]),
            lambda every: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(every).cast("long").alias("n_base"),
                F.array_min(every).cast("long").alias("first_word"),
                F.array_max(every).cast("long").alias("last_word"),
                F.array_compact(F.array(*one)).alias("found"),
            ),
        )

    return let(F.struct(*[phrase_places(w, phrase).alias(label) for phrase, label in PHRASES]), summed)


def notice_grams(spark: SparkSession, notices=NOTICES, size: int = GRAM) -> DataFrame:
    """`gram_hash, gram, notice, label, place, n, own`: every k-gram of every notice; `own` lists the places of
    the words that only notices of this license have."""
    rows = []
    for number, (label, text) in enumerate(notices):
        parts = text.split(" ")
        others = {w for name, other in notices if name != label for w in other.split(" ")}
        own = [j for j, w in enumerate(parts) if w not in others]
        for j in range(len(parts) - size + 1):
            rows.append((" ".join(parts[j : j + size]), number, label, j, len(parts), own))
    grams = spark.createDataFrame(rows, "gram string, notice int, label string, place int, n int, own array<int>")
    parts = F.split("gram", " ")
    return grams.withColumn("gram_hash", F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(size)]))


def spans(
    docs: DataFrame, notices=NOTICES, size: int = GRAM, gap: int = GAP, coverage: float = COVERAGE
) -> DataFrame:
    """`doc_id, text_hash, label, notice, first_word, last_word, votes, covered`: verified spans.

    `docs` has doc_id and text; rows that repeat both give their spans once. Texts and notices have any length.
    A null or empty text has no spans, and neither has a notice of fewer than `size` words.
    """
    grams = notice_grams(docs.sparkSession, notices, size)
    known = [r[0] for r in grams.select("gram_hash").distinct().collect()]  # as many as the notices have words

    def rolled(w: Column) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(none)
        hashed = F.transform(
            starts, lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"))
        )
        met = F.filter(hashed, lambda x: x["h"].isin(known))
        said = lambda x: F.concat_ws(" ", F.slice(w, x["i"] + 1, size))
        return F.transform(met, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), said(x).alias("said")))

    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(let(words(F.col("text")), rolled)))
    hits = found.join(F.broadcast(grams), (F.col("h") == F.col("gram_hash")) & (F.col("said") == F.col("gram")))
    key = ["doc_id", "text_hash", "notice", "label", "n", "own"]
    hits = hits.select(*key, (F.col("i") - F.col("place")).alias("diagonal"), "i", "place").distinct()
    along = Window.partitionBy(*key).orderBy("diagonal", "i")
    fresh = F.col("diagonal") - F.lag("diagonal").over(along) > gap
    merged = hits.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    merged = merged.withColumn("cluster", F.sum("fresh").over(along))
    # A set of places is at most as long as its notice.
    found = merged.groupBy(*key, "cluster").agg(
        F.count("*").alias("votes"),
        F.min("i").alias("first_word"),
        (F.max("i") + size - 1).alias("last_word"),
        F.collect_set("place").alias("starts"),
    )
    places = F.array_distinct(F.flatten(F.transform("starts", lambda j: F.sequence(j, j + size - 1))))
    found = found.withColumn("places", places).withColumn("covered", F.size("places") / F.col("n"))
    telling = 2 * F.size(F.array_intersect("places", "own")) >= F.size("own")
    return found.where((F.col("covered") >= coverage) & telling).drop("n", "own", "starts", "places", "cluster")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`, a row per row.

    The score is the best coverage of a verified span, 1 where a base phrase stands, 0 without either. A null or
    empty text has no words; a document without labels has empty ones. Rows with a null id
    are matched to their spans by their text, as are repeated rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = spans(rows).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("spanned"), F.max("covered").alias("best")
    )
    found = found.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spanned", "best")
    counted = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), let(words(F.col("text")), base).alias("base")
    )
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash"))
    joined = counted.join(found, same, "left")
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("base.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id",
        "base.n_words",
        "base.n_base",
        "base.first_word",
        "base.last_word",
        listed(F.col("base.found")).alias("base_labels"),
        listed(F.concat("base.found", F.coalesce("spanned", none))).alias("labels"),
        score.alias("score"),
    )


@query("op10_diagonal_voting")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
