"""Packing token sequences into windows by non-negative least squares over a length histogram.

Documents are cut at multiples of the window, so that only the last piece of each is shorter. Those
lengths are rounded up to units and counted. The plan sees nothing but this histogram, which has
`window / unit` entries whatever the corpus: shallow combinations of up to three lengths that fill a
window are enumerated, their repeat counts solved for by non-negative least squares, rounded down
and clipped, and what is left is packed greedily, the longest first. The plan is a short list of patterns
with repeat counts. Pieces take their place in it by their rank within their length, so sequences
are filled by joins and windows over small groups, without any list of pieces on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, query, short_batches, table, worker_state

WINDOW = 4096
UNIT = 16
END = 2
#: Entries after which a worker drops its cache of encoded words, about 100 MB.
CACHED = 400_000


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that works word by word between white space.

    Every chunk between blanks is encoded alone and remembered. Chunks of plain Latin letters, with
    at most one comma or full stop behind, skip the tokenizer's normalising and splitting, which
    leave them alone but for lower case. All others pass through the whole tokenizer.
    """

    LETTERS = frozenset(
        chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xDF, 0xF7)
    ) | {"ß"}

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache, self.number = _Words(self.encode), struct.Struct("<I").pack
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        kinds = [s.get("type") for s in ((steps.get("normalizer") or {}).get("normalizers") or [])]
        self.plain = "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def encode(self, chunk: str) -> bytes:
        """Ids of a chunk without blanks."""
        if self.plain and chunk:
            tail = chunk[-1]
            core = chunk[:-1] if tail in ",." else chunk
            if core and self.LETTERS.issuperset(core):
                if core is chunk and core.islower():
                    text = core if core.isascii() else "".join([self.shown[b] for b in core.encode()])
                    return b"".join([self.number(t.id) for t in self.model.tokenize(text)])
                return self.cache[core.lower()] + (b"" if core is chunk else self.cache[tail])
        ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return b"".join(map(self.number, ids))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


class _Words(dict):
    """Ids per chunk, encoded when first asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.encode(chunk)
        return ids


def pieces(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, id_column: str = "doc_id",
    text_column: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """`doc_id, row_id, start, length, ids_crc32, doc_tokens` (and `ids`): every document cut at
    multiples of the window.

    A null or empty text has its end token alone. `row_id` tells repeated rows of one document
    apart; it is not meant to be the same in two runs, so the result must be written before use.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = worker_state(f"tokenizer {tokenizer}", lambda: WordTokenizer(tokenizer))
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, row, text in zip(batch["doc_id"], batch["row_id"], batch["text"], strict=True):
                ids = (words.ids(text) if text else b"") + last
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    found = (doc, row, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    out.append((*found, np.frombuffer(part, "<u4").astype(np.int64)) if keep_ids else found)
            columns = ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
            yield pd.DataFrame(out, columns=columns)

    short_batches(docs)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInPandas(cut, schema + ", ids array<long>" * keep_ids)


def combinations(units: int) -> list[tuple[int, ...]]:
    """All multisets of one to three lengths that add up to `units`."""
    found: list[tuple[int, ...]] = [(units,)]
    found += [(units - b, b) for b in range(1, units // 2 + 1)]
    found += [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return found


def nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson)."""
    x, passive = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(matrix.T @ target).max(initial=0.0)))
    for _ in range(3 * matrix.shape[0]):
        slope = matrix.T @ (target - matrix @ x)
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        passive[best] = True
        while passive.any():
            at = np.flatnonzero(passive)
            solved = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            low = solved <= 1e-12
            if not low.any():
                x[at] = solved
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300))
            x[at] += step * (solved - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths in units, the longest first, with the number of windows each fills.

    `histogram[k]` is the number of pieces of k units. The patterns use every piece exactly once.
    """
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if units >= 1 and left[1:].any():
        shallow = combinations(units)
        matrix = np.zeros((units + 1, len(shallow)))
        for j, lengths in enumerate(shallow):
            for k in lengths:
                matrix[k, j] += 1
        scale = left.max()
        counts = np.floor(nnls(matrix[1:], left[1:] / scale) * scale + 1e-6).astype(np.int64)
        for j in np.flatnonzero(counts):
            need = np.bincount(shallow[j], minlength=units + 1)
            used = need > 0
            times = min(int(counts[j]), int((left[used] // need[used]).min()))
            if times > 0:
                left -= times * need
                out.append((shallow[j], times))
    while left[1:].any():
        room, pattern = units, []
        spare = left.copy()
        while room:
            fits = np.flatnonzero(spare[1 : room + 1])
            if not len(fits):
                break
            k = int(fits[-1]) + 1
            spare[k] -= 1
            pattern.append(k)
            room -= k
        need = np.bincount(pattern, minlength=units + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        left -= times * need
        out.append((tuple(pattern), times))
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], units: int) -> tuple[list[tuple], int]:
    """Rows `units, low, high, sequence, slot`: pieces with rank low..high-1 among those of their
    length lie at that slot of the sequences from `sequence` on. Also the number of sequences."""
    ranked, rows, sequence = np.zeros(units + 1, np.int64), [], 0
    for lengths, times in patterns:
        for slot, k in enumerate(lengths):
            rows.append((int(k), int(ranked[k]), int(ranked[k]) + times, sequence, slot))
            ranked[k] += times
        sequence += times
    return rows, sequence


def pack(found: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """`found` (written pieces) with `sequence_id` and `offset`.

    Full windows are sequences of their own. The others are ranked within their length; ranks are
    counted per length and salt, with the salts' totals added up, so a length that a third of the
    pieces share is spread out. An empty table gives an empty result.
    """
    spark = found.sparkSession
    units = -(-window // unit)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.ceil(F.col("length") / F.lit(unit)).cast("int")
    salt = F.pmod(F.xxhash64("doc_id", "row_id", "start"), F.lit(salts)).cast("int")
    placed = found.withColumn("_units", size).withColumn("_salt", salt)
    totals = placed.groupBy("_units", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_units").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = materialise(totals.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = np.zeros(units + 1, np.int64)
    for k, n in totals.groupBy("_units").agg(F.sum("n")).collect():  # at most window / unit rows
        histogram[k] = n
    slots, _ = _slots(plan(histogram), units)
    fixed = spark.createDataFrame(slots, "_units int, _low long, _high long, _sequence long, _slot int")
    order = Window.partitionBy("_units", "_salt").orderBy("doc_id", "row_id", "start")
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(totals.drop("n"), ["_units", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_salt")
    at = (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    filled = ranked.join(F.broadcast(fixed), (ranked["_units"] == fixed["_units"]) & at)
    filled = filled.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_low"))
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    return filled.withColumn("offset", offset).select(*found.columns, "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, unit: int = UNIT, **options) -> DataFrame:
    """Documents cut, written and packed; see `pieces` and `pack`. Other columns are ignored."""
    return pack(materialise(pieces(docs, tokenizer, window, **options), "pieces"), window, unit)


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    found = packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return found.select(*[F.col(c) if c == "doc_id" else F.col(c).cast("long") for c in names])


@query("op3_nnls_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return digest(table(spark, folder, "documents"))
