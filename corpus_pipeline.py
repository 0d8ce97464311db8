"""A corpus from raw documents: toxicity, quality rules, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_copies, packing, quality_rules, toxicity
from millrace.llm.common import materialise, table, unused

#: The rarest source is used at most this many times as often as the commonest.
REPETITIONS = 2.0


def toxic_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that are not toxic; the lexicon is learned as in the operator's query."""
    (score,) = unused(docs, "score")
    found = toxicity.rated(docs, table(spark, folder, "labels"), score)
    return found.where(f"{score} < 0.5").select(*docs.columns)


def rules_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the quality rules keep."""
    trusted = quality_rules.trusted_documents(table(spark, folder, "labels"))
    return quality_rules.rated(docs, trusted, evidence=quality_rules.EVIDENCE).where("rules.kept").select(*docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 and more."""
    return near_copies.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, those of rare sources again up to REPETITIONS passes."""
    return mixing.mixed(docs, repetitions=REPETITIONS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the packed sequences; a document that is used twice is packed twice."""
    return packing.digest(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("quality rules", rules_out),
    ("near-duplicates", copies_out),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenisers, hashes and fitted models have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
