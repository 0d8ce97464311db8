"""Quality rules: repeated words and lines, then the log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed to `buckets`. Two multinomials over the buckets are
counted: a trusted target, the documents labelled good, and the raw corpus, all documents. A
document's score is the mean over its n-grams of log((target + evidence) / (expected + evidence)), where
`expected` is the count that the raw share lets expect of the target, so buckets of which little is known
give about 0 however small the target is. Documents fall into folds by their id and each is scored by the
counts of the other folds, so none vouches for itself or against itself. A document is kept if
its score reaches the threshold: junk whose n-grams the target rarely has goes, however long it is.
Native expressions only: the logarithms are one array per fold, and a document's n-grams are looked up there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import NOT_SPACE, SPACE, let, query, table, unused

BUCKETS = 1 << 16
THRESHOLD = -0.15
#: Trusted occurrences that a bucket must let expect before its ratio counts for half or more.
EVIDENCE = 5.0
FOLDS = 5
#: Trusted ids up to which they are broadcast to the documents (16 MB); more are joined by a shuffle.
BROADCAST = 1_000_000
WINDOW = 5
# The symbols that count as such, and the limits of the base rule.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 10, 20


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def joined(first: Column, second: Column, ahead: int) -> Column:
    """Hashes of first[i] and second[i + ahead] for all i that have both."""
    count = F.greatest(F.size(second) - ahead, F.lit(0))
    return F.zip_with(F.slice(first, 1, count), F.slice(second, ahead + 1, count), lambda a, b: F.xxhash64(a, b))


def repeated_words(single: Column, pairs: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of five words found twice or more, from the hashes of words and pairs.

    Windows are told apart by 64 bits.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

        def step(acc: Column, p: Column) -> Column:
            more = F.least(F.lit(size), p + size - acc["end"])
            return F.struct((p + size).alias("end"), (acc["n"] + more).alias("n"))

        return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])

    def places(s: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            same = (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.when(F.coalesce(same, F.lit(False)), x["i"]).otherwise(-1)

        return F.filter(F.transform(s, mark), lambda p: p >= 0)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda s: covered(places(s)))
        )

    return let(joined(joined(pairs, pairs, 2), single, 4), count)


def base(text: Column, w: Column, single: Column, pairs: Column) -> Column:
    """Struct of the base counts of a text with words `w`; a null text has none of anything."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.length(F.array_join(w, ""))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_SPACE))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(single, pairs).alias("n_repeat_words"),
    )


def hashes(w: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body` with the hashes of all words and of all pairs of neighbouring words, each computed once."""
    single = F.transform(w, lambda x: F.xxhash64(x))
    return let(single, lambda h: let(joined(h, h, 1), lambda pairs: body(h, pairs)))


def bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def with_folds(docs: DataFrame, trusted: DataFrame, id_column: str, fold: str, good: str, folds: int) -> DataFrame:
    """`docs` with the fold of each document and whether it is trusted."""
    ids = trusted.select(F.col(id_column).alias(good)).where(F.col(good).isNotNull()).distinct()
    if ids.limit(BROADCAST + 1).count() <= BROADCAST:
        ids = F.broadcast(ids)
    name = F.col(f"`{id_column}`")
    marked = docs.join(ids, name == F.col(good), "left")
    return marked.withColumn(fold, F.pmod(F.xxhash64(name), F.lit(folds)).cast("int")).withColumn(good, F.col(good).isNotNull())


def ratios(
    marked: DataFrame, text_column: str, fold: str, good: str, buckets: int, folds: int, evidence: float
) -> DataFrame:
    """`fold, ratio`: for each fold the ratio of every bucket by the counts of all other folds.

    That is `folds` rows of `buckets` numbers each, whatever the size of the corpus.
    """
    grams = hashes(words(F.col(f"`{text_column}`")), lambda h, pairs: F.concat(h, pairs))
    found = marked.select(F.col(fold).alias("fold"), F.col(good).alias("good"), F.explode(grams).alias("hash"))
    counts = found.groupBy(bucket(F.col("hash"), buckets).alias("bucket"), "fold").agg(
        F.count("*").alias("raw"), F.count_if("good").alias("target")
    )
    others = lambda kind, k: F.coalesce(F.sum(F.when(F.col("fold") != k, F.col(kind))), F.lit(0))
    kinds = ("raw", "target")
    counts = counts.groupBy("bucket").agg(*[others(kind, k).alias(f"{kind}{k}") for kind in kinds for k in range(folds)])
    every = marked.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0)
    listed = [F.array(*[F.col(f"{kind}{k}") for k in range(folds)]).alias(kind) for kind in kinds]
    whole = counts.agg(
        *[F.sum(f"{kind}{k}").alias(f"{kind}{k}") for kind in kinds for k in range(folds)],
        F.array_sort(F.collect_list(F.struct("bucket", *listed))).alias("all"),
    )

    def of(k: int) -> Column:
        rate = F.col(f"target{k}") / F.greatest(f"raw{k}", F.lit(1))
        return F.transform("all", lambda x: F.log((x["target"][k] + evidence) / (rate * x["raw"][k] + evidence)))

    return whole.select(F.posexplode(F.array(*[of(k).cast("array<float>") for k in range(folds)])).alias("fold", "ratio"))


def rated(
    docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = BUCKETS,
    threshold: float = THRESHOLD, evidence: float = EVIDENCE, folds: int = FOLDS,
) -> DataFrame:
    """All rows and columns of `docs` and a struct `rules`: base counts, `base_failed`, `score`, `kept`.

    A null, empty or blank text has no words and fails the base rule; its score is 0. Without any
    trusted document no ratio is known: all scores are 0 and the base rule decides alone. Repeated rows count
    as often as they come; null ids are never trusted and share a fold. A text of any length is one row, with arrays as
    long as its words. A column `rules` of `docs` is replaced. An empty table gives an empty result.
    """
    fold, good, own, ratio = unused(docs, "fold", "good", "own", "ratio")
    marked = with_folds(docs, trusted, id_column, fold, good, folds)
    known = ratios(marked, text_column, fold, good, buckets, folds, evidence).toDF(own, ratio)
    marked = docs.withColumn(fold, F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(folds)).cast("int"))
    met = marked.join(F.broadcast(known), F.col(fold) == F.col(own))
    text = F.col(f"`{text_column}`")

    def of(w: Column) -> Column:
        return hashes(w, lambda h, pairs: rules(w, h, pairs))

    def rules(w: Column, h: Column, pairs: Column) -> Column:
        look = lambda start, values: F.aggregate(values, start, lambda a, x: a + F.get(F.col(ratio), bucket(x, buckets)))
        count = F.greatest(2 * F.size(w) - 1, F.lit(1))
        score = look(look(F.lit(0.0), h), pairs) / count
        return let(F.struct(base(text, w, h, pairs).alias("base"), score.alias("score")), judged)

    def judged(x: Column) -> Column:
        counts = x["base"]
        failed = (counts["n_words"] < LEAST_WORDS) | (
            100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"]
        )
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(
            *[counts[n].alias(n) for n in names],
            failed.alias("base_failed"),
            x["score"].alias("score"),
            (~failed & (x["score"] >= threshold)).alias("kept"),
        )

    # One expression, so that a filter on a field that is pushed below computes it once.
    return met.withColumn("rules", let(words(text), of)).drop(fold, own, ratio)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1").select("doc_id").distinct()


@query("op7_hashed_ngram_ratio")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    trusted = trusted_documents(table(spark, folder, "labels"))
    found = rated(table(spark, folder, "documents").select("doc_id", "text"), trusted)
    return found.select("doc_id", "rules.*")
