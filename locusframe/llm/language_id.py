"""Language identification: interpolated Kneser-Ney models of characters, one for each language, in sorted hash arrays.

A text is read as its letters and marks in lower case; whatever else it holds is a space, and spaces in a row are one. A
language's model of order 5 is fitted to a bounded sample of its texts: counts of 5-grams, and for shorter ones in how
many ways they are continued to the left, each less a discount, with what is discounted given to the next shorter
order, and at the end to an alphabet of fixed size. Its arrays are hashes of n-grams in ascending order with their
discounted shares, and hashes of contexts with the weight of the shorter order.

A text gets the language with the least cross-entropy in bits a character; of equal ones the first by name. Positions
of a stretch of text that share a 5-gram are looked up once. The score is the softmax of the cross-entropies times a
power of the length, fitted to stretches of texts that were kept out of learning; a text is rejected if that is under
one half or if its bits a character lie above nearly all of such stretches of its language, for its length.

Null texts and texts without letters are `und` with score 0, and rejected. Empty texts likewise. Texts of any length are read
whole, in stretches. Rows are scored one by one, so repeated ones alike; texts that are repeated are learned from once.
Null languages and those named `und` are not learned. Without any text to learn from everything is `und`. Empty tables give
no rows. Names of docs' other columns don't matter.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .texts import blocks
from .token_ids import forget

ORDER = 5
UNKNOWN = "und"
#: Languages that are learned, those with the most texts.
MOST_LANGUAGES = 1000
#: Code points that a language is learned from and texts that they come from, at most; all languages together; of one text.
MOST_CHARS, MOST_TEXTS, MOST_OF_ALL, MOST_OF_TEXT = 1 << 18, 2000, 1 << 24, 1 << 14
#: One of so many sampled texts is kept for calibration, where it is cut to these lengths.
KEPT_OUT, LENGTHS = 5, (12, 25, 50, 100, 400, MOST_OF_TEXT)
#: The share of stretches of their own language that the limit of bits a character lets through.
PASSES = 0.995
#: Characters that a model without any knowledge deals its share to.
ALPHABET = 1 << 12
#: Characters that are looked up at a time.
STRETCH = 1 << 19
_SPACE = np.uint32(32)
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: itself in lower case or a space, and whether it is a letter."""
    lower, letter = np.full(0x110000, _SPACE), np.zeros(0x110000, bool)
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            lower[ord(c)], letter[ord(c)] = ord(low) if len(low) == 1 else ord(c), kind == "L"
    return lower, letter


def characters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, first of each row and the end, whether a row has letters) of a block of texts.

    Each row starts with ORDER - 1 spaces, which are contexts only; a row that has nothing else has no text.
    """
    lower, letter = _characters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[starts]
    low = lower[points]
    has = np.concatenate(([0], np.cumsum(letter[points])))
    has = has[at[1:]] > has[at[:-1]]
    full = low != _SPACE
    keep = full.copy()
    keep[1:] |= full[:-1]
    keep[at[1:-1]] = full[at[1:-1]]
    first = np.concatenate(([0], np.cumsum(keep)))[at]
    pads = ORDER - 1
    out = np.insert(low[keep], np.repeat(first[:-1], pads), _SPACE)
    return out, first + pads * np.arange(len(first)), has


def hashed(chars: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each of ends."""
    out = np.zeros(len(ends), np.uint64)
    for j in range(n):
        out += chars[ends - j].astype(np.uint64) * _PLACE[j]
    return out


@dataclass
class Model:
    """For orders 1 to ORDER: hashes of n-grams, ascending, with their shares, and of contexts with the weight of shorter ones."""

    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def logs(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of each position's character, from hashes of the n-grams and contexts there."""
        p = np.full(len(grams[0]), 1 / ALPHABET)
        for k in range(ORDER):
            p = _found(self.contexts[k], self.weights[k], contexts[k], 1.0) * p + _found(self.grams[k], self.shares[k], grams[k], 0.0)
        return np.log2(p)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


def fit(chars: np.ndarray, first: np.ndarray) -> Model | None:
    """The model of the texts of one language; None where they hold nothing."""
    real = np.ones(len(chars), bool)
    for j in range(ORDER - 1):
        real[first[:-1] + j] = False
    ends, model = np.flatnonzero(real), []
    if not len(ends):
        return None
    for n in range(ORDER, 0, -1):
        grams, at, counts = np.unique(hashed(chars, ends, n), return_index=True, return_counts=True)
        ends = ends[at]  # one place of each, so that the next order counts how many ways lead to it
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        contexts, own = np.unique(hashed(chars, ends - 1, n - 1), return_inverse=True)
        total = np.bincount(own, counts)
        model.append((grams, ((counts - discount) / total[own]).astype(np.float32), contexts, (discount * np.bincount(own) / total).astype(np.float32)))
    return Model(*(list(x) for x in zip(*reversed(model), strict=True)))


@dataclass
class Identifier:
    """Models by language, in order of names, and what calibration gave.

    power, scale: the softmax is over scale * length ** power * cross-entropy. level, spread: of each language, bits a
    character and their variance in long and in single characters. limit: most spreads above the level.
    """

    names: list[str]
    models: list[Model]
    power: float = 0.5
    scale: float = 1.0
    level: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf

    def sums(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(rows, languages): bits of all characters of each row."""
        out, pads = np.zeros((len(first) - 1, len(self.models))), ORDER - 1
        for a in range(pads, len(chars), STRETCH):
            ends = np.arange(a, min(a + STRETCH, len(chars)))
            _, at, own = np.unique(hashed(chars, ends, ORDER), return_index=True, return_inverse=True)
            at = ends[at]
            grams, contexts = [hashed(chars, at, n) for n in range(1, ORDER + 1)], [hashed(chars, at - 1, n) for n in range(ORDER)]
            low = np.searchsorted(first, a, "right") - 1
            high = np.searchsorted(first, ends[-1], "right")
            begins = np.clip(first[low:high] + pads, a, ends[-1] + 1) - a
            stops = np.clip(first[low + 1 : high + 1], a, ends[-1] + 1) - a
            for j, model in enumerate(self.models):
                run = np.concatenate(([0.0], np.cumsum(model.logs(grams, contexts)[own])))
                out[low:high, j] -= run[np.maximum(stops, begins)] - run[begins]
        return out

    def entropies(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) bits a character, and characters of each row, 0 without letters."""
        chars, first, has = characters(data, starts)
        n = np.where(has, np.diff(first) - (ORDER - 1), 0)
        return self.sums(chars, first) / np.maximum(n, 1)[:, None], n

    def scores(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(rows, languages) that sum to 1."""
        z = -self.scale * np.maximum(n, 1)[:, None] ** self.power * (bits - bits.min(axis=1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def above(self, bits: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many spreads a row's bits lie above the level of the language own."""
        return (bits - self.level[own]) / np.sqrt(self.spread[own, 0] + self.spread[own, 1] / np.maximum(n, 1))

    def identify(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: language (-1 without letters), score, bits a character and whether it is rejected."""
        rows = len(starts) - 1
        if not self.models:
            return np.full(rows, -1), np.zeros(rows), np.zeros(rows), np.ones(rows, bool)
        bits, n = self.entropies(data, starts)
        best, row = bits.argmin(axis=1), np.arange(rows)
        score = self.scores(bits, n)[row, best]
        out = score < 0.5
        if self.level is not None:
            out |= self.above(bits[row, best], n, best) > self.limit
        none = n == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, bits[row, best]), out | none

    def calibrate(self, bits: np.ndarray, n: np.ndarray, own: np.ndarray) -> None:
        """Fits the softmax and the limits to stretches, whose language is own."""
        if not len(n):
            return
        row, found = np.arange(len(n)), []
        for self.power in np.linspace(0, 1, 11):
            for self.scale in 2.0 ** np.arange(-3, 6, 0.5):
                found.append((-np.log(np.maximum(self.scores(bits, n)[row, own], 1e-12)).mean(), self.power, self.scale))
        _, self.power, self.scale = min(found)
        right, long = bits[row, own], n >= 100
        level, spread = right[long].mean() if long.any() else right.mean(), [max(right.var(), 1e-4)] * 2
        self.level, self.spread = np.full(len(self.models), level), np.tile(spread, (len(self.models), 1))
        for k in range(len(self.models)):
            mine, short = (own == k) & long, (own == k) & ~long
            if mine.sum() > 5 and short.sum() > 5:
                self.level[k] = right[mine].mean()
                self.spread[k] = max(right[mine].var(), 1e-4), max(((right[short] - self.level[k]) ** 2 * n[short]).mean(), 1e-4)
        self.limit = float(np.quantile(self.above(right, n, own), PASSES))


def sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, part, hash, size): texts to learn from, different ones, of each language those with the least hashes.

    At most MOST_TEXTS a language and the code points named above. A text longer than MOST_OF_TEXT gives a stretch from a
    place that its hash chooses. What is shuffled is about twice the sample, whatever the table holds.
    """
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - MOST_OF_TEXT + 1, F.lit(1))).cast("int")
    have = docs.where(learn & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & F.col(text).isNotNull())
    have = have.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    sizes = have.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("texts"))
    known = F.broadcast(sizes.orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES))  # few rows by that bound
    near = have.join(known, "lang").where(F.shiftrightunsigned("hash", 32) * F.col("texts") < (1 << 32) * 2.0 * MOST_TEXTS)
    parts = near.select("lang", "hash", F.substring("text", place + 1, F.lit(MOST_OF_TEXT)).alias("part"))
    once = parts.groupBy("lang", "hash").agg(F.min("part").alias("part")).withColumn("order", F.shiftrightunsigned("hash", 32))
    ranked = once.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY order, hash) AS rank", "sum(length(part)) OVER (PARTITION BY lang ORDER BY order, hash) AS size")
    return ranked.where(F.col("rank") <= MOST_TEXTS).select("lang", "part", "hash", "size")


def _block(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [p.encode() + b" " for p in parts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Identifier:
    """An identifier of the languages of docs' rows where learn holds.

    A language is fitted by one task, from its part of the sample; models come to the driver, as many n-grams at most as the sample has
    code points, for each order.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = sample(docs, learn, text, lang).persist()
    languages = max(1, chosen.select("lang").distinct().count())
    most = min(MOST_CHARS, MOST_OF_ALL // languages)
    chosen_most = chosen.where(F.col("size") - F.length("part") < most)
    kept_out = F.pmod("hash", F.lit(KEPT_OUT)) == 0

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        chars, first, _ = characters(*_block(list(rows["part"])))
        m = fit(chars, first)
        if m is None:
            return pd.DataFrame({"lang": [], "n": [], "grams": [], "shares": [], "contexts": [], "weights": []})
        columns = {"grams": m.grams, "shares": m.shares, "contexts": m.contexts, "weights": m.weights}
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "n": range(ORDER)} | {k: [x.tobytes() for x in v] for k, v in columns.items()})

    fitted = chosen_most.where(~kept_out).groupBy("lang").applyInPandas(one, "lang string, n int, grams binary, shares binary, contexts binary, weights binary")
    found: dict[str, list] = {}
    for r in sorted(fitted.collect(), key=lambda r: (r["lang"], r["n"])):
        read = lambda k, kind: np.frombuffer(r[k], kind)  # noqa: B023, E731
        found.setdefault(r["lang"], []).append((read("grams", np.uint64), read("shares", np.float32), read("contexts", np.uint64), read("weights", np.float32)))
    out = Identifier(list(found), [Model(*(list(x) for x in zip(*v, strict=True))) for v in found.values()])
    cuts = [F.substring("part", F.pmod(F.col("hash"), F.greatest(F.length("part") - n, F.lit(1))).cast("int") + 1, F.lit(n)) for n in LENGTHS]
    held = chosen_most.where(kept_out).select("lang", F.explode(F.array_distinct(F.array(*cuts))).alias("part"))
    _calibrate(out, held)
    chosen.unpersist()
    return out


def _calibrate(identifier: Identifier, held: DataFrame) -> None:
    """From (lang, part), whose number follows the sample."""
    if not identifier.models:
        return
    shared = held.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, starts in blocks(batch.column(1)):
                bits, n = shared.value.entropies(data, starts)
                yield pa.record_batch([batch.column(0)[row : row + len(n)], pa.array(n), pa.array(list(bits), pa.list_(pa.float64()))], ["lang", "n", "bits"])

    names = {x: i for i, x in enumerate(identifier.names)}
    rows = sorted(tuple(r) for r in held.mapInArrow(run, "lang string, n long, bits array<double>").collect() if r["n"] and r["lang"] in names)
    if rows:
        identifier.calibrate(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([names[r[0]] for r in rows]))
    shared.unpersist()


def identify(docs: DataFrame, identifier: Identifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang, score, bits_per_char and rejected of every row; rejected rows have their best language too."""
    have = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = shared.value
        names = np.array([*own.names, UNKNOWN], object)
        for batch in batches:
            for row, data, starts in blocks(batch.column(1)):
                best, score, bits, out = own.identify(data, starts)
                yield pa.record_batch([batch.column(0)[row : row + len(best)], pa.array(names[best], pa.string()), pa.array(score), pa.array(bits), pa.array(out)], [key, "lang", "score", "bits_per_char", "rejected"])

    ship(docs.sparkSession)
    return have.mapInArrow(run, f"`{key}` {have.dtypes[0][1]}, lang string, score double, bits_per_char double, rejected boolean")
