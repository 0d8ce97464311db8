"""Near copies by word shingles: MinHash shards, BK-trees for candidates, exact Jaccard, components.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. Each text has `BANDS` keys, every one of `ROWS` minima; the texts that share a key are a shard.
Each shard has BK-trees over SimHash fingerprints of the shingle sets, and what a search finds within
`RADIUS` is a candidate. A candidate becomes a link only if the exact similarity of the two sets reaches
the threshold. A tree holds leaders alone: a text that is near a leader follows it, and by the triangle inequality (one less
the similarity is a distance) what is near the leader need not be compared with its followers, and what is far from it
cannot be near them. So a large group of copies costs a comparison a text and loses no link. Shingles are told apart by 64 bits. Only texts that share a key with another one travel
with their shingles. A shard above `CAPACITY` is cut into trees that the whole shard searches. From each
tree only the links that join two of its parts are kept, so a group gives as many links as texts.
At a similarity of 0.8 a pair shares a key with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9998; its
fingerprints differ in about 10 bits with a deviation of 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, short_batches, unused
from millrace.llm.components import components
from millrace.llm.simhash import BKTree, _Parts

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 16
RADIUS = 24
CAPACITY = 1024
#: Shingles that are hashed at a time, so that a very long text needs little memory.
CHUNK = 4096


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all windows of `size` words, sorted; a shorter text is one window.

    Words are those of the fingerprints: A-Z in lower case, cut at ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - size + 1)
    grams = [b" ".join(words[i : i + size]) for i in range(count)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))


def fingerprint(held: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles; 0 without any."""
    if not len(held):
        return 0
    bits = np.unpackbits(held.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    draw = lambda: rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def band_keys(held: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One signed 64-bit key for each band of minima."""
    times, plus = factors
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), CHUNK):
        mixed = held[at : at + CHUNK, None] * times + plus
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * times).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


class Leaders:
    """One tree of a shard: leaders by fingerprint, their followers, and the parts that links have joined."""

    def __init__(self, radius: int, least: float) -> None:
        self.radius, self.least, self.reach = radius, least, radius
        self.tree, self.parts = BKTree(), _Parts()
        self.at: dict[int, list[dict]] = {}

    def _joined(self, key: bytes, other: bytes, found: list[bytes]) -> None:
        if self.parts.join(key, other):
            found.append(other)

    def meet(self, key: bytes, x: int, held: np.ndarray, stay: bool) -> list[bytes]:
        """Keys of this tree that links to `key` newly join with it; if `stay`, it is found by later ones."""
        found: list[bytes] = []
        home = None
        for y in self.tree.within(x, self.reach):
            bits = (x ^ y).bit_count()
            for leader in self.at[y]:
                if bits > self.radius + leader["bits"] or self.parts.find(key) == self.parts.find(leader["key"]):
                    continue
                theirs, slack = leader["held"], 1 - self.least + leader["far"] + 1e-9
                small, large = sorted((len(held), len(theirs)))
                if large and 1 - small / large > slack:
                    continue
                near = similarity(held, theirs)
                if near >= self.least:
                    self._joined(key, leader["key"], found)
                    home = home or (leader, bits, 1 - near)
                elif 1 - near <= slack:
                    self._among(key, x, held, 1 - near, leader, found)
        if stay:
            self._add(key, x, held, home)
        return found

    def _among(self, key: bytes, x: int, held: np.ndarray, far: float, leader: dict, found: list[bytes]) -> None:
        """Followers that can be near although their leader is not; one is enough, as they are all joined."""
        for other, print_, theirs, off in leader["followers"]:
            if far - off <= 1 - self.least + 1e-9 and (x ^ print_).bit_count() <= self.radius:
                if similarity(held, theirs) >= self.least:
                    self._joined(key, other, found)
                    return

    def _add(self, key: bytes, x: int, held: np.ndarray, home: tuple[dict, int, float] | None) -> None:
        if home:
            leader, bits, far = home
            leader["followers"].append((key, x, held, far))
            leader["bits"], leader["far"] = max(leader["bits"], bits), max(leader["far"], far)
            self.reach = max(self.reach, self.radius + leader["bits"])
            return
        if x not in self.at:
            self.tree.add(x)
        self.at.setdefault(x, []).append({"key": key, "held": held, "followers": [], "bits": 0, "far": 0.0})


def sketches(texts: DataFrame) -> DataFrame:
    """`key, fp, bands` of `texts(key, text)`."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = _factors()
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": batch["key"], "fp": prints, "bands": [band_keys(s, factors) for s in sets]})

    return texts.mapInPandas(of, "key binary, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """`key, held`: the sorted 64-bit shingles of `texts(key, text)`, as bytes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "held": [shingles(t).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(of, "key binary, held binary")


def links(texts: DataFrame, radius: int = RADIUS, capacity: int = CAPACITY, least: float = SIMILARITY) -> DataFrame:
    """`a, b`: links between the keys of `texts(key, text)` that connect all near copies found.

    `key` must be distinct. Every listed pair reaches the similarity; not every pair is listed, but the
    listed ones have the same components as all that share a shard and lie within the radius.
    """
    known = materialise(sketches(texts), "sketches")
    placed = known.select("key", "fp", F.posexplode("bands").alias("band", "value"))
    sizes = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    placed = placed.join(sizes, ["band", "value"]).select("band", "value", "key", "fp", trees.alias("trees"))
    placed = materialise(placed, "shards")
    sets = shingle_sets(texts.join(placed.select("key").distinct(), "key", "left_semi"))
    own = F.pmod(F.xxhash64("key"), F.col("trees")).cast("int")
    placed = placed.join(sets, "key").withColumn("own", own)
    placed = placed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    guest = (F.col("own") != F.col("tree")).alias("guest")
    spread = placed.select("band", "value", "tree", guest, "key", "fp", "held").repartition("band", "value", "tree")
    ordered = spread.sortWithinPartitions("band", "value", "tree", "guest", "key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            a, b = [], []
            columns = (batch[c].tolist() for c in ("band", "value", "tree", "guest", "key", "fp", "held"))
            for band, value, number, is_guest, key, signed, held in zip(*columns, strict=True):
                if shard != (band, value, number):
                    shard, leaders = (band, value, number), Leaders(radius, least)
                x, mine, key = signed & 0xFFFFFFFFFFFFFFFF, np.frombuffer(held, np.uint64), bytes(key)
                others = leaders.meet(key, x, mine, stay=not is_guest)
                a += [key] * len(others)
                b += others
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return ordered.mapInPandas(search, "a binary, b binary")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id, key, component_id`, one row per row of `docs`: the smallest id that links reach.

    Equal texts share a key. Texts that are null, empty or blank are near copies of each other. Rows with
    a null id belong to a component and can join others to it, but never name it.
    """
    short_batches(docs)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    smallest = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("least")), "keys")
    texts = materialise(rows.select("key", "text").dropDuplicates(["key"]), "texts")
    near = components(materialise(links(texts), "links"))
    joined = smallest.join(near.withColumnRenamed("node", "key"), "key", "left")
    joined = materialise(joined.withColumn("component", F.coalesce("component", "key")), "components")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(names, "component").select("key", "component_id")
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of near copies, with all columns: the one that names the group.

    Rows that repeat id and text count as one. Different texts under one id each stay if the id names
    their group; texts without an id stay only where no other text of the group has one.
    """
    name, key = unused(docs, "name", "key")
    near = near_copies(docs, id_column, text_column).where("doc_id <=> component_id")
    kept = near.select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct()
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(name)) & (F.unhex(F.md5(text.cast("binary"))) == F.col(key))
    return docs.join(kept, same, "left_semi").dropDuplicates([id_column, text_column])
