"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

A character language model over 27 symbols (a to z, and the break between words) is counted over
all documents. Words that can be disguised (digits and signs that stand for letters, signs between or around
letters, doubled letters, single letters with blanks between) become a lattice of readings, the plain one
among them, of which Viterbi search takes the likeliest under the model. All other words, and words with letters that the
model has no symbol for, are their own only reading. The lexicon is learned from
labelled documents: words, word beginnings, and beginnings that several words share, which toxic
documents have and others lack, chosen one after another so that every toxic document is covered a few times. A document's evidence is the sum of the
weights of the entries it holds, and a logistic curve turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, materialise, query, short_batches, table

ORDER = 4
SYMBOLS = 27
#: Labelled documents at most that the lexicon is fitted on, by the hash of their id.
FIT = 12_000
#: Candidates at most among which the lexicon is chosen, by the number of toxic documents.
CANDIDATES = 5_000
#: A candidate's toxic share, the documents' cover, and the chance that any entry is a candidate by luck.
PRECISION, COVER, LUCK = 0.95, 6, 0.01
CACHED = 250_000

# Letters that signs and digits stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: Signs at the edge of a word that stand for no letter.
EDGE = ".,;:?\"'()[]{}<>*#%&~`-_=/\\^«»“”„’…¿¡"
#: Costs of leaving out a letter of two equal ones, of reading a digit or a sign as no letter, and of an
#: exclamation mark, or a sign three times and more, that ends a word as no letter.
ONE_OF_TWO, NO_LETTER, MARK = 7.0, 3.0, 0.3
RUN = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:\s+(?:[^\W_]|[@$!|+])){2,}(?=[.,;:!?)]*(?:\s|$))")
DOUBLE = re.compile(r"(.)\1+")
#: A word of letters, with signs at its end alone.
LETTERS_FIRST = re.compile(r"([^\W\d_]+)[@$!|+]*")


def _codes() -> np.ndarray:
    import unicodedata

    table = np.zeros(256, np.int64)
    for i in range(256):
        letter = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if "a" <= letter <= "z" and chr(i).isalpha():
            table[i] = ord(letter) - 96
    table[0xDF] = 19
    return table


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    """Symbols of a text: 1 to 26 for letters without accents, 0 for everything else."""
    return codes[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]


def character_counts(docs: DataFrame) -> DataFrame:
    """`gram, n`: occurrences of every sequence of four symbols in `docs(text)`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total = _codes(), np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for text in batch["text"]:
                x = np.concatenate(([0] * (ORDER - 1), encode(text or "", codes), [0]))
                grams = x[: len(x) - ORDER + 1]
                for i in range(1, ORDER):
                    grams = grams * SYMBOLS + x[i : len(x) - ORDER + 1 + i]
                if len(grams) > SYMBOLS**ORDER // 8:
                    total += np.bincount(grams, minlength=SYMBOLS**ORDER)
                else:
                    np.add.at(total, grams, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    found = docs.select("text").mapInPandas(count, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Log-probabilities of a symbol after three others, interpolated with shorter contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        full = np.zeros(SYMBOLS**ORDER)
        full[grams] = counts
        full = full.reshape((SYMBOLS,) * ORDER)
        p = (full.sum(axis=(0, 1, 2)) + 1) / (full.sum() + SYMBOLS)
        for drop in range(ORDER - 2, -1, -1):
            part = full.sum(axis=tuple(range(drop)))
            p = (part + 5 * p) / (part.sum(axis=-1, keepdims=True) + 5)
        self.log = np.log(p).astype(np.float32)

    def decode(self, steps: list[list[tuple[tuple[int, ...], float]]]) -> list[int]:
        """The likeliest reading of a lattice: per step a list of (symbols, cost). States are the last
        three symbols, of which the options of three steps leave few, so the search is exact."""
        log = self.log
        states = {(0, 0, 0): (0.0, None)}
        for options in [*steps, [((0,), 0.0)]]:
            ahead: dict = {}
            for state, (score, path) in states.items():
                for symbols, cost in options:
                    (a, b, c), s, at = state, score - cost, path
                    for y in symbols:
                        if y or c:
                            s += log.item(a, b, c, y)
                            a, b, c, at = b, c, y, (at, y)
                    if (a, b, c) not in ahead or ahead[a, b, c][0] < s:
                        ahead[a, b, c] = (s, at)
            states = ahead
        path = max(states.values(), key=lambda v: v[0])[1]
        out = []
        while path is not None:
            path, y = path
            out.append(y)
        return out[::-1]


def lattice(text: str, codes: np.ndarray) -> list[list[tuple[tuple[int, ...], float]]]:
    """Readings of each run of equal characters of a disguised word, with their costs."""
    steps = []
    for run in re.finditer(r"(.)\1*", text, re.DOTALL):
        c, n = run[1], len(run[0])
        if c in LEET:
            fewer = ONE_OF_TWO if n == 2 else 0.0
            options = [((ord(x) - 96,) * k, 0.5 * k + (fewer if k == 1 else 0.0)) for x in LEET[c] for k in {1, min(n, 2)}]
            ends = run.end() == len(text) and (c == "!" or (n > 2 and not c.isdigit()))
            cost = MARK if ends else NO_LETTER * min(n, 2)
            options.append(((0,), cost))
            if not c.isdigit() and not ends:
                options.append(((), cost))
        elif (y := int(codes[ord(c)]) if ord(c) < 256 else 0) > 0:
            options = [((y,), (0.0, ONE_OF_TWO, 0.3)[min(n, 3) - 1])] + ([((y, y), 0.0)] if n > 1 else [])
        else:
            options = [((), 0.7), ((0,), 1.0)]
        steps.append(options)
    return steps


class Restorer:
    """Restored words of raw ones."""

    def __init__(self, model: CharacterModel) -> None:
        self.model, self.codes = model, _codes()
        self.known = {chr(i) for i in np.flatnonzero(self.codes)}

    def read(self, disguised: str) -> tuple[str, ...]:
        symbols = self.model.decode(lattice(disguised, self.codes))
        return tuple("".join(chr(96 + y) if y else " " for y in symbols).split())

    def word(self, raw: str) -> tuple[str, ...]:
        """Readings of one raw lower-case word: itself, or what the lattice restores."""
        core = raw.strip(EDGE)
        if not core:
            return ()
        if core.isalpha():
            runs = [m.span() for m in DOUBLE.finditer(core)]
            if not runs:
                return (core,)
        letters = [c for c in core if c.isalpha()]
        if not letters and not any(c in LEET for c in core):
            return ()
        if not all(c in self.known for c in letters):
            return tuple(re.findall(r"[^\W\d_]+", core))
        if len(letters) == len(core) and len(runs) == 1 and runs[0][1] - runs[0][0] == 2 and self._pair_stays(core, runs[0][0]):
            return (core,)
        found = self.read(core)
        return (core,) if len(letters) == len(core) == sum(map(len, found)) else found

    def _pair_stays(self, core: str, at: int) -> bool:
        """What the lattice of a word with one pair of equal letters, at `at`, decides: both of its readings
        are alike but for the symbols whose context has the second letter."""
        log, both = self.model.log, [0, 0, 0, *encode(core, self.codes).tolist(), 0]
        p = at + 4
        one = both[:p] + both[p + 1 :]
        with_both = sum(log.item(*both[i - 3 : i + 1]) for i in range(p, min(p + 4, len(both))))
        with_one = sum(log.item(*one[i - 3 : i + 1]) for i in range(p, min(p + 3, len(one))))
        return with_both > with_one - ONE_OF_TWO

    def spaced(self, text: str) -> list[str]:
        """Words restored from three and more single characters with blanks between."""
        found: list[str] = []
        for run in RUN.finditer(text):
            found += self.read(re.sub(r"\s+", " ", run[0]))
        return found

    def text(self, text: str) -> str:
        """The whole text restored, words separated by blanks."""
        low = RUN.sub(lambda m: " ".join(self.read(re.sub(r"\s+", " ", m[0]))), text.lower())
        return " ".join(w for raw in low.split() for w in self.word(raw))


def entries(word: str) -> list[str]:
    """What a word can match in the lexicon: itself, and its first four to eight letters."""
    out = [word] if len(word) > 2 else []
    return out + [f"{word[:k]}-" for k in range(4, min(9, len(word)))]


def counted(found: Counter) -> set[str]:
    """Entries with their counts: a beginning that two or three different words share is one more entry."""
    out = set(found)
    for k in (2, 3):
        out.update(f"{e}{k}" for e, n in found.items() if n >= k and e[-1] == "-")
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    bias: float = 0.0

    def score(self, evidence: float) -> float:
        z = max(-60.0, min(60.0, self.slope * evidence + self.bias))
        return 1 / (1 + math.exp(-z))


class Holder:
    """Entries that texts hold: all, or those in `wanted`. Raw words are remembered."""

    def __init__(self, restorer: Restorer, wanted: set[str] | None = None) -> None:
        self.restorer, self.wanted = restorer, wanted
        self.held: dict[str, tuple[str, ...]] = {}
        self.idle: set[str] = set()
        self.plain = {i: chr(96 + int(y)) for i, y in enumerate(restorer.codes) if y}
        self.fours = {e[:4] for e in wanted or () if e[-1] == "-"}
        self.starts = {self._start(e.rstrip("-")) for e in wanted or ()}

    def _start(self, letters: str) -> str:
        """Up to five first letters, without accents and equal ones in a row."""
        return DOUBLE.sub(r"\1", letters.translate(self.plain))[:5]

    def _may_hold(self, raw: str) -> bool:
        """False only for words of letters, or of letters with signs behind, of which no reading holds a wanted
        entry. Readings of such a word differ in doubled letters and at the end, so they start alike."""
        core = raw.strip(EDGE)
        if core.isalpha() and not DOUBLE.search(core):
            return core in self.wanted or core[:4] in self.fours
        found = LETTERS_FIRST.fullmatch(core)
        if not found:
            return True
        start = self._start(found[1])
        return len(start) < 5 or any(start[:k] in self.starts for k in (5, 4, 3, 2, 1))

    def _word(self, raw: str) -> tuple[str, ...]:
        if self.wanted is not None and not self._may_hold(raw):
            return ()
        got = {e for w in self.restorer.word(raw) for e in entries(w)}
        return tuple(got if self.wanted is None else got & self.wanted)

    def entries(self, text: str | None) -> set[str]:
        found: Counter = Counter()
        if not text:
            return set()
        low = text.lower()
        for raw in set(low.split()) - self.idle:
            got = self.held.get(raw)
            if got is None:
                got = self._word(raw)
                if not got:
                    self.idle.add(raw)
                    continue
                self.held[raw] = got
            found.update(got)
        for w in set(self.restorer.spaced(low)):
            found.update(e for e in entries(w) if self.wanted is None or e in self.wanted)
        if len(self.held) + len(self.idle) > CACHED:
            self.held.clear()
            self.idle.clear()
        return counted(found)


def choose(rows: list[set[str]], precision: dict[str, float], cover: int = COVER) -> list[str]:
    """Entries that cover each toxic document up to `cover` times, the most useful first.

    Of entries that the same documents hold only the longest is used, as it says most.
    """
    holders: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        for e in row:
            holders.setdefault(e, []).append(i)
    longest: dict[tuple, str] = {}
    for e in sorted(holders, key=lambda e: (len(e), e)):
        longest[tuple(holders[e])] = e
    names = sorted(longest.values())
    at = {n: i for i, n in enumerate(names)}
    held = np.zeros((len(rows), len(names)), bool)
    for i, row in enumerate(rows):
        held[i, [at[e] for e in row if e in at]] = True
    need = np.full(len(rows), cover)
    worth = np.array([precision[n] for n in names])
    chosen: list[str] = []
    while len(chosen) < len(names):
        gain = held[need > 0].sum(axis=0)
        best = int(np.argmax(gain * worth))
        if gain[best] < max(3, 0.004 * len(rows)):
            break
        chosen.append(names[best])
        need -= held[:, best]
        held[:, best] = False
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and bias of a one-dimensional logistic curve, by Newton steps."""
    data, beta = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        step = np.linalg.solve(
            (data * (p * (1 - p))[:, None]).T @ data + ridge * np.eye(2), data.T @ (y - p) - ridge * beta
        )
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def distinct_rows(sample: DataFrame, model: CharacterModel) -> DataFrame:
    """`toxic, sketch, held` of `sample(text, toxic)`: the entries of each text, once for each label and set.

    `sketch` is a 128-bit hash of the whole set, so rows that count as one are equal in all columns and it
    does not matter which of them stays.
    """

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        holder = Holder(Restorer(model))
        for batch in batches:
            held = [sorted(holder.entries(t)) for t in batch["text"]]
            sketch = [xxhash.xxh3_128_hexdigest("\n".join(h).encode("utf-8", "surrogatepass")) for h in held]
            yield pd.DataFrame({"toxic": batch["toxic"], "sketch": sketch, "held": held})

    rows = sample.mapInPandas(hold, "toxic int, sketch string, held array<string>")
    return materialise(rows, "held").dropDuplicates(["toxic", "sketch"])


def fit(sample: DataFrame, model: CharacterModel) -> Lexicon:
    """A lexicon from `sample(text, toxic)`, which must be bounded.

    Documents with the same set of entries count once, so that copies of one document do not make its
    words look telling. Without toxic or without other documents the lexicon is empty and the score
    the share of toxic ones.
    """
    rows = materialise(distinct_rows(sample, model), "held")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        share = positive / (positive + negative) if positive + negative else 0.0
        return Lexicon(bias=math.log((share + 1e-6) / (1 - share + 1e-6)))
    counts = rows.select("toxic", F.explode("held").alias("entry")).groupBy("entry").agg(
        F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")
    )
    counts = materialise(counts, "entries")
    tested = max(1, counts.count())
    support = math.ceil(math.log(LUCK / tested) / math.log(positive / (positive + negative)))
    support = min(support, max(3, positive // 10))  # a few documents cannot show more
    counts = counts.where((F.col("n1") >= support) & (F.col("n1") >= PRECISION * (F.col("n1") + F.col("n0"))))
    top = counts.orderBy(F.desc("n1"), "n0", "entry").limit(CANDIDATES).collect()
    known = {r["entry"]: (r["n1"], r["n0"]) for r in top}
    listed = sample.sparkSession.createDataFrame([(e, 1) for e in known], "entry string, hit int")
    short = rows.select("toxic", "sketch", F.explode_outer("held").alias("entry"))
    short = short.join(F.broadcast(listed), "entry", "left")  # at most CANDIDATES entries
    hits = F.collect_list(F.when(F.col("hit") == 1, F.col("entry"))).alias("hits")
    short = short.groupBy("toxic", "sketch").agg(hits)
    documents = short.collect()
    precision = {e: a / (a + b) for e, (a, b) in known.items()}
    toxic = [set(d["hits"]) for d in documents if d["toxic"] == 1]
    chosen = choose(toxic, precision) if known else []
    weights = {
        e: math.log((known[e][0] + 0.5) / (positive + 1)) - math.log((known[e][1] + 0.5) / (negative + 1))
        for e in chosen
    }
    evidence = np.array([sum(weights.get(e, 0.0) for e in d["hits"]) for d in documents])
    slope, bias = logistic(evidence, np.array([d["toxic"] for d in documents], float))
    return Lexicon(weights, slope, bias)


def scored(docs: DataFrame, model: CharacterModel, lexicon: Lexicon, text_column: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the score of the restored text, from 0 to 1."""
    restorer_of = lambda: Restorer(model)
    wanted = {e.rstrip("23") for e in lexicon.weights}

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        holder = Holder(restorer_of(), wanted)
        for texts in batches:
            found = []
            for text in texts:
                held = holder.entries(text)
                found.append(lexicon.score(sum(lexicon.weights.get(e, 0.0) for e in held)))
            yield pd.Series(found, dtype=float)

    return docs.withColumn(name, of(F.col(f"`{text_column}`")))


def labelled(docs: DataFrame, labels: DataFrame, column: str, of: int, remainder: int, most: int) -> DataFrame:
    """`text` and the label of at most `most` labelled documents outside the held-out part.

    Rows that repeat an id, a text and a label count once; of an id with several texts or labels each counts.
    The bound holds for the rows that are returned, whatever is repeated: they are picked by id and checksum of the
    text, and only the texts of picked ones are read.
    """
    known = labels.where(f"{column} in (0, 1) and doc_id is not null").where(~held_out("doc_id", of, remainder))
    known = known.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(most)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    rows = docs.select("doc_id", "text")
    found = rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("label_id", "label", digest)
    order = [F.xxhash64("label_id"), "label_id", "digest", "label"]
    picked = materialise(found.distinct().orderBy(*order).limit(most), "picked")
    same = [F.col("doc_id") == F.col("label_id"), digest == F.col("digest")]
    texts = rows.join(F.broadcast(picked), same).dropDuplicates(["label_id", "digest", "label"])
    return texts.select("text", F.col("label").alias(column))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[CharacterModel, Lexicon]:
    """The character model of all `docs` and the lexicon of the labelled ones that are not held out."""
    short_batches(docs)
    grams = character_counts(docs).toPandas()  # at most SYMBOLS ** ORDER rows
    model = CharacterModel(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(float))
    return model, fit(labelled(docs, labels, "toxic", 5, 0, FIT), model)


def rated(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """All rows and columns of `docs(doc_id, text, ...)` with a toxicity score named `name`.

    Null, empty and blank texts hold no entry and get the score of that. Null ids and labels other than
    0 and 1 teach nothing; repeated rows are scored alike. Texts are scored whole, whatever their length. A column
    that has the name already is replaced. An empty table gives an empty result.
    """
    model, lexicon = learn(docs, labels)
    return scored(docs, model, lexicon, name=name)


@query("op1_noisy_channel")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = rated(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", predicted)
