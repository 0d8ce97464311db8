"""Ranked lexical search with pipelined term partitions.

Documents are cut into slices of at most `SLICE`. A slice has one posting list for each term that an item
may hold: places, counts and document lengths, by ascending doc_id. Terms are dealt to a few owners by
falling weight, so rare terms are met first. Item bundles, one for each item and slice, carry sparse
accumulators (place, score) from owner to owner: each stage cogroups the bundles with the owner's
posting lists and adds integer contributions. Between stages the tenth best score so far of each item
is a threshold, and the most that the terms still to come can add is known from their highest
contributions. Accumulators that cannot reach the threshold go, and once no unmet document can
reach it a bundle takes in no new ones. Both are exact, so common terms, which come last, touch
few documents. The last stage leaves the ten best of every bundle for the final selection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, table

TOP, OWNERS = 10, 4
#: Documents and postings of a slice, and items of a block; they bound what a task holds.
SLICE, POSTINGS, BLOCK = 4096, 1 << 19, 256
#: Bits of the filter over the items' terms that goes to all tasks: half a megabyte, whatever the items.
FILTER_BITS = 1 << 22
#: Terms that a worker remembers.
CACHED = 1 << 20

# Letters that are lower-cased, and what separates terms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


def item_terms(items: DataFrame, text_column: str) -> DataFrame:
    """`item_row, block, term, times` of `items(item_row, block, …)`."""
    low = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(low, BREAK), lambda w: w != "")
    spread = items.select("item_row", "block", F.explode(words).alias("term"))
    return spread.groupBy("item_row", "block", "term").agg(F.count("*").alias("times"))


def term_filter(terms: DataFrame) -> bytes:
    """A bit for the hash of each term."""
    at = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    bits = terms.select(F.shiftright(at, 5).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {FILTER_BITS}) & 31 as int))").alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    held = np.zeros(FILTER_BITS // 32, "<u4")
    held[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return held.tobytes()


class _Wanted(dict):
    """Whether a term passes the filter, hashed when first asked for."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) > CACHED:
            self.clear()
        at = (xxhash.xxh64_intdigest(term, 42)) % FILTER_BITS
        self[term] = passes = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return passes


class _Slice:
    """Posting lists of some documents."""

    SCHEMA = pa.schema(
        [("slice", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())),
         ("counts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]
    )

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, int, dict[bytes, int]]] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: str | None, wanted: _Wanted) -> None:
        terms, found = terms_of(text), {}
        for term in filter(wanted.__getitem__, terms):
            found[term] = found.get(term, 0) + 1
        self.docs.append((doc_id, len(terms), found))
        self.postings += len(found)

    def full(self) -> bool:
        return len(self.docs) >= SLICE or self.postings >= POSTINGS

    def rows(self, name: int) -> pa.RecordBatch:
        """One row without a term for the ids and lengths of all documents, and one per term."""
        self.docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        lists: dict[bytes, tuple[list, list, list]] = {}
        for place, (_, length, found) in enumerate(self.docs):
            for term, count in found.items():
                held = lists.get(term)
                if held is None:
                    held = lists[term] = ([], [], [])
                held[0].append(place)
                held[1].append(count)
                held[2].append(length)
        ids, lengths = [d[0] for d in self.docs], [d[1] for d in self.docs]
        size = len(lists) + 1
        columns = [
            [name] * size,
            [None, *(t.decode() for t in lists)],
            [[], *(x[0] for x in lists.values())],
            [[], *(x[1] for x in lists.values())],
            [lengths, *(x[2] for x in lists.values())],
            [ids, *[None] * len(lists)],
        ]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.SCHEMA, strict=True)], self.SCHEMA)


def slices(docs: DataFrame, bits: bytes) -> DataFrame:
    """Posting lists of `docs(doc_id, text)`, and one row per slice with all ids and lengths."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, current = _Wanted(bits), _Slice()
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                current.add(doc_id, text, wanted)
                if current.full():
                    yield current.rows(name)
                    name, current = name + 1, _Slice()
        if current.docs:
            yield current.rows(name)

    kinds = "slice long, term string, places array<int>, counts array<int>, lengths array<int>, ids array<long>"
    return docs.mapInArrow(of, kinds)


def div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs, rounded down for positive ones."""
    return F.call_function("div", a, b)


def gain(count: Column, length: Column, docs: int, terms: int) -> Column:
    """What a term found `count` times in a document of `length` terms gives for each unit of its weight."""
    count, length = count.cast("long"), length.cast("long")
    spread = F.lit(100 - 75) + div(75 * length * F.lit(docs), F.lit(max(terms, 1)).cast("long"))
    return div(F.lit(1_000_000_000) * count, 1000 * count + 8 * spread)


def add_up(bundles: pd.DataFrame, lists: pd.DataFrame, most: int | None) -> pd.DataFrame:
    """The bundles of a block and slice after one owner: accumulators with the owner's contributions.

    A bundle that is not open only adds to the places it carries. The last owner leaves the `most` best.
    """
    names = ["item_row", "slice", "places", "scores"]
    if not len(bundles):
        return pd.DataFrame([], columns=names)
    owned = {r.term: (r.places, np.asarray(r.gains, np.int64)) for r in lists.itertuples()}
    carried = [np.asarray(p, np.int64) for p in bundles["places"]]
    met = [*carried, *(p for p, _ in owned.values())]
    score = np.zeros(1 + max((int(p[-1]) for p in met if len(p)), default=0), np.int64)
    columns = (bundles[c] for c in ("item_row", "slice", "open", "scores", "terms", "weights"))
    out = []
    for places, item, name, opened, scores, terms, weights in zip(carried, *columns, strict=True):
        score[:] = 0
        score[places] = scores
        for term, weight in zip(terms, weights, strict=True):
            if term in owned:
                where, gained = owned[term]
                score[where] += int(weight) * gained
        found = np.flatnonzero(score) if opened else places
        if most is not None and len(found) > most:
            found = np.sort(found[np.argsort(-score[found], kind="stable")[:most]])
        out.append((item, name, found.astype(np.int32), score[found]))
    return pd.DataFrame(out, columns=names)


def adder(most: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda bundles, lists: add_up(bundles, lists, most)


def threshold(bundles: DataFrame, top: int) -> DataFrame:
    """`item_row, least`: the score that `top` documents of an item have reached; no row for fewer documents."""
    best = F.slice(F.sort_array("scores", asc=False), 1, top)
    along = Window.partitionBy("item_row").orderBy(F.desc("score"))
    reached = bundles.select("item_row", F.explode(best).alias("score")).withColumn("at", F.row_number().over(along))
    return reached.where(F.col("at") <= top).groupBy("item_row").agg(
        F.max(F.when(F.col("at") == top, F.col("score"))).alias("least")
    )


def ranked(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", top: int = TOP, owners: int = OWNERS,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `top` highest-scoring documents of each item, ties by ascending id.

    A null or empty text has no terms: such a document is not counted and never found, such an item has
    no rows. Rows that repeat an id are documents or items of their own. Documents without an id rank
    behind others of their score with a null doc_id; an item without an id keeps a null item_id. Without
    documents or items the result is empty. A text's terms are held by one task at a time, however long it is.
    Other columns are ignored.
    """
    items = materialise(
        items.select(
            F.monotonically_increasing_id().alias("item_row"),
            F.col(f"`{item_column}`").alias("item_id"),
            F.col(f"`{item_text_column}`").alias("text"),
        ),
        "items",
    )
    blocks = max(1, -(-items.count() // BLOCK))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)).cast("int"))
    terms = materialise(item_terms(placed, "text"), "terms")
    bits = term_filter(terms.select("term").distinct())
    given = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    index = materialise(slices(given, bits), "slices")
    heads = index.where("term is null")
    met = heads.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)),
    ).first()
    count, total = met[0] or 0, met[1] or 0
    gains = F.zip_with("counts", "lengths", lambda c, n: gain(c, n, count, total))
    lists = index.where("term is not null").select("slice", "term", "places", gains.alias("gains"))
    known = lists.groupBy("term").agg(F.sum(F.size("places")).alias("df"), F.max(F.array_max("gains")).alias("best"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1)))
    weighed = terms.join(known, "term").withColumn("weight", weight).where("weight > 0")
    weighed = materialise(weighed, "weights")
    shares = [k / owners for k in range(owners - 1, 0, -1)]
    cuts = weighed.select("term", "weight").distinct().agg(F.percentile_approx("weight", shares)).first()[0] or []
    owner = sum((F.when(F.col("weight") < cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    weighed = weighed.select(
        "item_row", "block", "term", owner.alias("owner"), (F.col("times") * F.col("weight")).alias("weight"),
        (F.col("times") * F.col("weight") * F.col("best")).alias("most"),
    )
    bundles = heads.select("slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    bundles = bundles.join(weighed.select("item_row", "block").distinct(), "block").select(
        "item_row", "slice", F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("scores")
    )
    for number in range(owners):
        own = F.col("owner") == number
        plan = weighed.groupBy("item_row", "block").agg(
            F.collect_list(F.when(own, F.struct("term", "weight"))).alias("own"),
            F.coalesce(F.sum(F.when(F.col("owner") >= number, F.col("most"))), F.lit(0)).alias("ahead"),
        )
        if number:
            plan = plan.join(threshold(bundles, top), "item_row", "left")
        else:
            plan = plan.withColumn("least", F.lit(None).cast("long"))
        plan = plan.withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
        pairs = F.filter(F.arrays_zip("places", "scores"), lambda x: x["scores"] + F.col("ahead") >= F.col("least"))
        ready = bundles.join(plan, "item_row").select(
            "item_row", "block", "slice", (F.col("ahead") >= F.col("least")).alias("open"), pairs.alias("held"),
            F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"),
        )
        ready = ready.where(F.col("open") | (F.size("held") > 0)).select(
            "*", F.col("held.places").alias("places"), F.col("held.scores").alias("scores")
        )
        wanted = weighed.where(own).select("term", "block").distinct()
        owned = lists.join(wanted, "term").select(
            F.col("block").alias("of_block"), F.col("slice").alias("of_slice"), "term", "places", "gains"
        )
        both = ready.drop("held").groupBy("block", "slice").cogroup(owned.groupBy("of_block", "of_slice"))
        found = both.applyInPandas(
            adder(top if number == owners - 1 else None), "item_row long, slice long, places array<int>, scores array<long>"
        )
        bundles = materialise(found, "bundles")
    least = threshold(bundles, top)
    final = bundles.select("item_row", "slice", F.explode(F.arrays_zip("places", "scores")).alias("x"))
    final = final.select("item_row", "slice", F.col("x.places").alias("place"), F.col("x.scores").alias("score"))
    final = final.join(least, "item_row", "left").where("least is null or score >= least")
    final = final.join(heads.select("slice", "ids"), "slice").withColumn("doc_id", F.get("ids", F.col("place")))
    along = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "slice", "place")
    final = final.select("item_row", "doc_id", "score", F.row_number().over(along).alias("rank"))
    return final.where(F.col("rank") <= top).join(items, "item_row").select("item_id", "rank", "doc_id", "score")


SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
items as (
  select row_number() over () as i, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
wanted as (select i, item_id, term, count(*) as times from items group by all),
whole as (select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from docs where len(terms) > 0),
words as (select r, doc_id, len(terms) as n, unnest(terms) as term from docs),
tf as (select r, doc_id, n, term, count(*) as tf from words semi join wanted using (term) group by all),
df as (select term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
       from tf cross join whole group by term, n_docs),
part as (select r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) as gain
         from tf cross join whole),
score as (select i, item_id, r, doc_id, cast(sum(times * w * gain) as bigint) as score
          from wanted join part using (term) join df using (term) group by all),
ranked as (select item_id, cast(row_number() over (partition by i order by score desc, doc_id nulls last, r) as integer) as rank,
             doc_id, score from score where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query("op12_term_pipeline", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
