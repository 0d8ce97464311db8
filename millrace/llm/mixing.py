"""Mixing sources to target weights by temperature.

Source shares of the tokens are raised to an exponent and normalised. The exponent is found by
bisection, so that the weights reach an entropy or the rarest source is not repeated more often than
a limit. Sums over sources are Spark aggregates, one per step, so the number of sources does not matter.
The weights are realised as a budget of tokens per source: its documents are dealt to about
sqrt(n) blocks, and every pass over the source takes the blocks in a new permutation until the
budget is spent. The last block is cut between documents, in their permuted order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, materialise, query, table, unused

REPETITIONS = 4.0
STEPS = 30


def token_count(text: Column) -> Column:
    """Words of a text, at least 1 so that every document has a weight; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.greatest(F.size(F.split(trimmed, f"{SPACE}+")), F.lit(1)).cast("long")


def _sums(sources: DataFrame, exponent: float) -> tuple[float, float, float, float]:
    """Normaliser, entropy, and the smallest and largest of weight / share at an exponent."""
    p = F.col("share")
    row = sources.agg(
        F.sum(F.pow(p, F.lit(exponent))),
        F.sum(F.pow(p, F.lit(exponent)) * F.log(p)),
        F.min(p),
        F.max(p),
    ).first()
    whole, weighted, least, most = map(float, row)
    entropy = math.log(whole) - exponent * weighted / whole
    ratios = [x ** (exponent - 1) / whole for x in (least, most)]
    return whole, entropy, min(ratios), max(ratios)


def exponent_for(
    sources: DataFrame, entropy: float | None = None, repetitions: float | None = None, steps: int = STEPS
) -> float:
    """The exponent in [0, 1] by bisection; `sources` has `share`.

    With `entropy` (of the weights, in nats), the largest exponent that reaches it, or 0 if none does.
    With `repetitions`, the smallest at which no source is passed over more than that many times the
    passes of the source passed over least.
    """

    def flat_enough(a: float) -> bool:
        _, found, low, high = _sums(sources, a)
        return found >= entropy if entropy is not None else high / low > repetitions

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if entropy is not None else high


def mixed(
    docs: DataFrame, entropy: float | None = None, repetitions: float | None = REPETITIONS,
    budget: float | None = None, seed: int = 0, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The columns of `docs`, then a struct `mix`: `tokens, weight, epoch, block, rank`, a row per use.

    `budget` counts tokens; by default it is such that the source used least is passed over exactly once, so
    every document is in the mixture. `rank` runs from 0 to 1 within each source; ordered by it the
    mixture has the wanted weights all along. A null source is a source; null texts and empty ones
    count one token; repeated rows and null ids are rows like any other. A column `mix` of `docs` is replaced.
    An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() != "mix"]
    row_, tokens_, source_, size_, block_, epoch_ = unused(
        docs, "row", "tokens", "mix_source", "size", "block", "epoch"
    )
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names],
        token_count(F.col(f"`{text_column}`")).alias(tokens_),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_column}`").cast("string")), F.lit("")).alias(source_),
        F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias(row_),
    )
    facts = rows.select(F.col(source_).alias("source"), F.col(tokens_).alias("tokens"), F.col(row_).alias("row"))
    facts = facts.groupBy("source", "row").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    facts = materialise(facts, "facts")
    sources = facts.groupBy("source").agg(F.sum("tokens").alias("total"), F.sum("rows").alias("size"))
    total = sources.agg(F.sum("total")).first()[0] or 0
    sources = materialise(sources.withColumn("share", F.col("total") / F.lit(float(max(total, 1)))), "sources")
    exponent = 1.0
    if total and (entropy is not None or repetitions is not None):
        exponent = exponent_for(sources, entropy, repetitions)
    whole, _, low, _ = _sums(sources, exponent) if total else (1.0, 0.0, 1.0, 1.0)
    spend = total / low if budget is None and total else float(budget or 0)
    weight = F.pow("share", F.lit(exponent)) / F.lit(whole)
    passes = F.round(weight * F.lit(spend) / F.col("total"), 9)
    sources = sources.select(
        "source", "total", weight.alias("weight"), passes.alias("passes"),
        F.ceil(F.sqrt("size")).cast("long").alias("blocks"),
    )
    sources = materialise(sources, "sources")
    used = facts.join(sources, "source").withColumn("block", F.pmod("row", "blocks"))
    totals = used.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int")))
    totals = totals.join(sources.where("passes > 0"), "source").withColumn("epoch", epochs)
    permuted = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "block", "epoch"), "block")
    before = F.sum("block_tokens").over(permuted.rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("before", F.coalesce(before, F.lit(0)))
    room = F.col("total") * (F.col("passes") - F.col("epoch")) - F.col("before")
    totals = totals.withColumn("room", room).where("room > 0")
    full = totals.where("room >= block_tokens")
    cut = totals.where("room < block_tokens")  # one block per source
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64("row", "epoch"), "row")
    shared = used.select("source", "block", "row", "tokens")
    part = shared.join(cut, ["source", "block"]).withColumn(
        "done", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    columns = ["source", "row", "weight", "epoch", "block", "passes", "total"]
    part = part.where(F.col("done") < F.col("room")).select(*columns, (F.col("before") + F.col("done")).alias("at"))
    every = shared.join(full, ["source", "block"]).select(*columns, F.col("before").alias("at"))
    uses = part.unionByName(every)
    rank = ((F.col("epoch") + F.col("at") / F.col("total")) / F.col("passes")).alias("rank")
    uses = uses.select(
        F.col("source").alias(f"{source_}_"), F.col("row").alias(f"{row_}_"), "weight", "epoch", "block", rank
    ).withColumnsRenamed({c: f"{c}_of_mix_" for c in ("weight", "epoch", "block", "rank")})
    same = (F.col(source_) == F.col(f"{source_}_")) & (F.col(row_) == F.col(f"{row_}_"))
    mix = F.struct(
        F.col(tokens_).alias("tokens"),
        *[F.col(f"{c}_of_mix_").alias(c) for c in ("weight", "epoch", "block", "rank")],
    )
    return rows.join(uses, same).select(*[F.col(f"`{c}`") for c in names], mix.alias("mix"))


@query("op6_temperature_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).select("doc_id", "source", "mix.*")
