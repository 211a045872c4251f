"""Quality rules: gradient-boosted trees over statistics of whole documents, with monotonic constraints.

Trees are grown by histograms on the logistic loss. A split on a constrained feature is taken only if its
children's values keep the order, and the children's subtrees are held on their sides of the middle, so more
symbols, shouting or repetition never raise a score. Scoring runs over flat node arrays for all documents of a
block at once.

A document fails the base rules if it has fewer than MIN_WORDS words or more than half of its words lie in
windows of three words that come twice or more. Null texts and empty texts have no words and so fail. Rows are
judged one by one; repeated rows get equal verdicts. Without labels of both kinds the trees are empty and the
base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from . import labelled
from .texts import _BYTE, _IS_SPACE, BLOCK, PIECE, Words, _hashes, blocks, run_hashes
from .token_ids import forget

MIN_WORDS = 50
#: Hashes of a long text that are sorted at a time, up to 256 times as many.
SORTED = 1 << 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What trees see, with -1 where a higher value must not raise the score.
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "exclaims_per_word": -1, "bars_per_word": -1, "digits_per_char": 0, "words_per_line": 0, "stops_per_word": 0, "commas_per_word": 0, "wide_share": 0,
}
_SYMBOL, _KINDS = np.zeros(256, bool), {}
_SYMBOL[list(b"#*$%&|<>")] = True
for _name, _bytes in {"upper": range(65, 91), "lower": range(97, 123), "exclaim": b"!", "bar": b"|", "digit": range(48, 58), "stop": b".", "comma": b",;", "wide": range(192, 256)}.items():
    _KINDS[_name] = np.zeros(256, bool)
    _KINDS[_name][list(_bytes)] = True
_STARTS = np.ones(256, bool)
_STARTS[128:192] = False  # bytes that continue a character
_STARTS &= ~_IS_SPACE


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, starts[:-1], dtype=np.int64)  # no row is without a byte


def _repeats(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the items whose value comes twice or more in their row, and of those that have an equal before them."""
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def _last(starts: np.ndarray) -> np.ndarray:
    """Flags of the last byte of each row."""
    out = np.zeros(starts[-1], bool)
    out[starts[1:] - 1] = True
    return out


def _repeat_words(words: Words) -> np.ndarray:
    """How many words of each row lie in windows of three words that come twice or more in it."""
    n = words.counts()
    h, first = words.windows(3)
    hit = np.zeros(len(words.start) + 3, bool)
    rows = np.arange(len(n))
    run_row = np.repeat(rows, np.diff(first))
    twice = np.flatnonzero(_repeats(h, run_row)[0])
    at = words.first[run_row[twice]] + twice - first[run_row[twice]]
    for j in range(3):
        hit[at + j] = True
    word_row = np.repeat(rows, n)
    return np.bincount(word_row[hit[: len(word_row)]], minlength=len(n))


def _equals(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, twice, later) of the hashes of one text, flags as of _repeats, by parts that hold all equals of theirs and about SORTED hashes."""
    parts = 1 << min(8, (len(h) // SORTED).bit_length())
    part = h.view(np.uint8)[7::8] & np.uint8(parts - 1)
    for i in range(parts):
        at = np.flatnonzero(part == i)
        yield at, *_repeats(h[at], np.broadcast_to(0, len(at)))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in stretches of about PIECE bytes that end with white space, as its last byte is."""
    begin = 0
    for a in range(0, len(data), PIECE):
        space = np.flatnonzero(_IS_SPACE[data[a : a + PIECE]])
        if len(space):  # else a word goes on
            yield data[begin : a + space[-1] + 1]
            begin = a + space[-1] + 1


def _long_dup_lines(data: np.ndarray, lines: int) -> tuple[int, int]:
    """How many lines with a word a text has, and how many of them have an equal before them; it has `lines` lines at most."""
    h, n, begin, spoken = np.empty(lines, np.uint64), 0, 0, 0
    for a in range(0, len(data), PIECE):
        own = data[a : a + PIECE]
        before = np.concatenate(([0], np.cumsum(~_IS_SPACE[own])))
        ends = np.flatnonzero(own == 10)
        if a + PIECE >= len(data):
            ends = np.append(ends, len(own) - 1)
        if len(ends):
            begins = np.concatenate(([begin], a + ends[:-1] + 1))
            said = before[ends] - before[np.maximum(begins - a, 0)]
            said[0] += spoken
            begin, spoken = a + ends[-1] + 1, before[-1] - before[ends[-1]]
            found = _hashes(data, begins[said > 0], a + ends[said > 0], _BYTE)
            h[n : n + len(found)] = found
            n += len(found)
        else:
            spoken += before[-1]
    return n, sum(np.count_nonzero(later) for _, _, later in _equals(h[:n]))


def _long_repeat_words(data: np.ndarray, n: int) -> int:
    """As _repeat_words, of a text of n words."""
    h, at, rest = np.empty(max(n - 2, 0), np.uint64), 0, np.zeros(0, np.uint64)
    for piece in _pieces(data):
        words = np.concatenate((rest, Words(piece, np.array([0, len(piece)]), lower=False).hash))
        found = run_hashes(words, 3)
        h[at : at + len(found)] = found
        at, rest = at + len(found), words[-2:]
    hit = np.zeros(n, bool)
    for places, twice, _ in _equals(h):
        for j in range(3):
            hit[places[twice] + j] = True
    return np.count_nonzero(hit)


def _long_counts(data: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """As _counts, of one long text, by stretches. Beside the text, 10 bytes are held for each word, or 9 for each line."""
    of_byte, n, inside = np.zeros(256, np.int64), 0, False
    for a in range(0, len(data), PIECE):
        own = data[a : a + PIECE]
        of_byte += np.bincount(own, minlength=256)
        word = np.concatenate(([inside], ~_IS_SPACE[own]))
        n, inside = n + np.count_nonzero(word[1:] > word[:-1]), word[-1]
    lines, dup_lines = _long_dup_lines(data, int(of_byte[10]) + 1)
    one = lambda x: np.array([x])
    out = {"n_words": one(n), "word_chars": one(of_byte[_STARTS].sum()), "n_symbols": one(of_byte[_SYMBOL].sum()), "n_dup_lines": one(dup_lines), "n_repeat_words": one(_long_repeat_words(data, n))}
    return out, one(lines), {k: one(of_byte[v].sum()) for k, v in _KINDS.items()}


def _counts(data: np.ndarray, starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """BASE, the number of lines with a word, and the numbers of bytes of each of _KINDS, of each row of a block."""
    words = Words(data, starts, lower=False)
    out = {"n_words": words.counts(), "word_chars": _sums(_STARTS[data], starts), "n_symbols": _sums(_SYMBOL[data], starts)}
    ends = np.flatnonzero((data == 10) | _last(starts))
    begins = np.concatenate(([0], ends[:-1] + 1))
    spoken = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begins)
    begins, ends = begins[spoken], ends[spoken]
    line_row = np.searchsorted(starts, begins, "right") - 1
    rows = len(starts) - 1
    out["n_dup_lines"] = np.bincount(line_row[_repeats(_hashes(data, begins, ends, _BYTE), line_row)[1]], minlength=rows)
    out["n_repeat_words"] = _repeat_words(words)
    return out, np.bincount(line_row, minlength=rows), {k: _sums(v[data], starts) for k, v in _KINDS.items()}


def statistics(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """BASE and FEATURES of each row of a block. A text longer than BLOCK is a block of its own and is read in stretches."""
    out, lines, kinds = _long_counts(data) if len(starts) == 2 and len(data) > BLOCK else _counts(data, starts)
    n = out["n_words"]
    some = np.maximum(n, 1)
    chars = np.maximum(out["word_chars"], 1)
    out |= {
        "log_words": np.log1p(n), "chars_per_word": out["word_chars"] / some, "symbols_per_word": out["n_symbols"] / some,
        "dup_line_share": out["n_dup_lines"] / np.maximum(lines, 1), "repeat_share": out["n_repeat_words"] / some,
        "upper_share": kinds["upper"] / np.maximum(kinds["upper"] + kinds["lower"], 1), "exclaims_per_word": kinds["exclaim"] / some,
        "bars_per_word": kinds["bar"] / some, "digits_per_char": kinds["digit"] / chars, "words_per_line": n / np.maximum(lines, 1),
        "stops_per_word": kinds["stop"] / some, "commas_per_word": kinds["comma"] / some, "wide_share": kinds["wide"] / chars,
    }
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Trees:
    """Node arrays of all trees, roots first known by root; a leaf's feature is -1."""

    bias: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: Sequence[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Trees for probabilities of y; signs holds -1, 0 or 1 for each feature."""
    share = float(y.mean()) if len(y) else 0.5
    bias = np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)) if len(y) else 0.0
    nodes: list[list] = []
    root: list[int] = []
    if 0 < share < 1 and len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
        total = np.full(len(y), bias)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            worth = lambda a, b: np.clip(-a / (b + penalty), low, high)
            me, best = len(nodes), (1e-6, None)
            nodes.append([-1, 0.0, 0, 0, float(worth(g.sum(), h.sum())) * rate])
            if level < depth:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g, len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], h, len(c) + 1))[:-1]
                    gr, hr = g.sum() - gs, h.sum() - hs
                    a, b = worth(gs, hs), worth(gr, hr)
                    fine = (hs > least) & (hr > least) & (signs[f] * (b - a) >= 0)
                    loss = lambda gg, hh, w: gg * w + 0.5 * (hh + penalty) * w * w
                    parent = worth(g.sum(), h.sum())
                    gain = np.where(fine, loss(g.sum(), h.sum(), parent) - loss(gs, hs, a) - loss(gr, hr, b), -1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, a[k], b[k]))
                if best[1]:
                    f, k, a, b = best[1]
                    middle = (a + b) / 2
                    to_left = binned[rows, f] <= k
                    bounds = {0: (low, high, low, high), -1: (middle, high, low, middle), 1: (low, middle, middle, high)}[signs[f]]
                    left = grow(rows[to_left], level + 1, *bounds[:2])
                    right = grow(rows[~to_left], level + 1, *bounds[2:])
                    nodes[me][:4] = [f, float(cuts[f][k]), left, right]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            root.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
            now = Trees(0.0, np.array(root[-1:]), *_arrays(nodes), depth)
            total += -np.log(1 / now.score(x) - 1)
    return Trees(bias, np.array(root, int), *_arrays(nodes), depth)


def _arrays(nodes: list[list]) -> list[np.ndarray]:
    columns = list(zip(*nodes, strict=True)) or [()] * 5
    return [np.array(c, kind) for c, kind in zip(columns, (int, float, int, int, float), strict=True)]


def table(docs: DataFrame, key: str, text: str, trees: Trees | None, more: Sequence[str] = ()) -> DataFrame:
    """key and `more` columns, BASE, then FEATURES without trees, or base_failed, score and kept with them."""
    last = list(FEATURES) if trees is None else ["base_failed", "score", "kept"]
    kinds = dict.fromkeys(BASE, "long") | dict.fromkeys(FEATURES, "double") | {"base_failed": "boolean", "score": "double", "kept": "boolean"}
    have = docs.select(key, *more, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row, data, starts in blocks(batch.column(len(more) + 1), BLOCK):
                s = statistics(data, starts)
                if trees is not None:
                    failed, score = base_failed(s), trees.score(np.stack([s[f] for f in FEATURES], axis=1))
                    s |= {"base_failed": failed, "score": score, "kept": ~failed & (score >= 0.5)}
                own = [batch.column(i)[row : row + len(starts) - 1] for i in range(len(more) + 1)]
                yield pa.record_batch([*own, *[pa.array(s[c]) for c in BASE + last]], [key, *more, *BASE, *last])

    ship(docs.sparkSession)
    schema = ", ".join([*(f"`{c}` {dict(have.dtypes)[c]}" for c in (key, *more)), *(f"{c} {kinds[c]}" for c in BASE + last)])
    return have.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Trees from the bounded sample of labelled rows; only their statistics are shuffled and come to the driver."""
    known = labelled.rows(docs.select(key, text), labels.select(key, label), key, label)
    found = labelled.least(table(known, key, text, None, ["__label", "__hash"]).select(key, "__label", "__hash", *FEATURES), key).orderBy(key).collect()
    x = np.array([[r[f] for f in FEATURES] for r in found], float).reshape(len(found), len(FEATURES))
    y = np.array([r["__label"] for r in found], float)
    return fit(x, y, list(FEATURES.values()))


def rules(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, BASE, base_failed, score and kept of every row."""
    return table(docs, key, text, trees)


def filter_docs(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row, data, starts in blocks(batch.column(at), BLOCK):
                s = statistics(data, starts)
                kept = ~base_failed(s) & (trees.score(np.stack([s[f] for f in FEATURES], axis=1)) >= 0.5)
                yield batch.slice(row, len(kept)).filter(pa.array(kept))

    ship(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
