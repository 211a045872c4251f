"""Language model scores by online logistic context mixing.

A text is its lower-cased words and an end. The TOP most frequent tokens are symbols of their own; the others share
RARE slots by their first two bytes. A symbol is coded as bits: first, where the words before it have been seen in
other texts, whether it is one of those that followed there; if not, the bits of its Huffman code. Every bit is
predicted by several contexts, whose predictions are weighed in the logistic domain with weights that a gate
chooses, and weights learn from the bits of the text itself, after every STEP tokens. So a text's score depends on
no other text of the scoring run.

* Code bits are predicted by a hashed context and by two classes. The hashed context is that of the first bit, below: how
  often it came with symbols on either side of each node of the code, in other texts (see paths). The classes are the
  last frequent word, and how frequent the last two words are. A table holds what followed in each class at each node of the code, one cell for each, smoothed towards the node's
  plain share.
* The context of the first bit is as many words before as are needed to tell a place of the corpus from others
  (log2 of its tokens and EXTRA bits of information, MOST_WORDS words at most). Counts of contexts and of what
  followed are held for every token of every training text, in shards whose number follows the number of tokens, and
  a training text is held against them without its own counts (those of the code's tables and of rare words include
  it). The bit is predicted from how often such bits came true just before, over a longer stretch, and for contexts
  seen as often.

Within its slot a known rare word has its share of the counts; new words have a part of the slot by the number of
words seen once (Good and Turing), times the probability of their spelling by byte trigrams, given the slot. All
parts are proper distributions.

Nothing is sampled, and no table or count has a fixed capacity: TOP only decides which words have codes of their
own; counts of all others are looked up in shards like those of contexts. What travels are arrays of one block and
shard each: a block asks once for each of its keys, says how often they come in its training texts, and the sums over
all blocks come back in the same order. So nothing is a row for each token, and a text of any frequency is no skew.

Null texts are empty: an end alone. Repeated and null keys are scored row by row. Very long texts go through in parts
that carry their weights on. Without training rows counts are empty, V and N are 0, and the model is uniform over its
few symbols. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace
from .texts import BLOCK, Words, blocks, mix

TOP, RARE = 1 << 17, 1 << 12
#: Symbols that count as frequent words, and the classes of the two contexts of code bits.
OFTEN = 63
CLASSES = (OFTEN + 1, 16)
#: Ranks that bound the kinds of words in the second one.
KINDS = (64, 4096)
#: Bits beyond those that tell all tokens apart, and words, of the context of the first bit.
EXTRA, MOST_WORDS = 2.0, 6
#: Bits of a key in its shard: of the context's hash and of the symbol itself, so that no two symbols of a context are one. A shard has 2 ** SHARD tokens or so.
CONTEXT_BITS, SYMBOL_BITS, SHARD = 26, 18, 20
KEY_BITS = CONTEXT_BITS + SYMBOL_BITS
#: Tokens of a block, and those that are mixed at a time.
TOKENS, PART = 1 << 19, 1 << 16
STEP = 64
#: Weights that a text starts with: of the plain share, the two classes and the hashed context; of the three predictions of the first bit.
CODE_WEIGHTS, COPY_WEIGHTS = (-0.3, 0.9, 0.4, 0.2), (0.4, 0.4, 0.4)
CODE_RATE, COPY_RATE = 0.02, 0.05
#: Strength of the plain share in a cell of a table, and in a hashed context.
SMOOTH, HASHED = 3.0, 4.0
_DEPTHS = 4
_GATES = _DEPTHS * CLASSES[1]
_COPY_GATES = 9
END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
_U = np.uint64


def slot_of(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """The slot, below RARE, of words by their first two bytes; a word of one byte has the space after it."""
    return ((b1.astype(np.int64) * 40503 + b2.astype(np.int64) * 30269) >> 3) & (RARE - 1)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """Hashes of all tokens of a block as longs, the first token of each row and the end, the words, and where the words lie among the tokens.

    The low bits of a word's hash are its slot.
    """
    words = Words(data, starts)
    n = len(starts) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(len(words.hash) + n, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    low = _lower(data)
    slot = slot_of(low[words.start], np.where(words.end - words.start > 1, low[np.minimum(words.start + 1, len(data) - 1)], 32)) if len(words.start) else np.zeros(0, np.int64)
    out[is_word] = (words.hash.view(np.int64) & ~np.int64(RARE - 1)) | slot
    out[~is_word] = END
    return out, first, words, np.flatnonzero(is_word)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting, which takes a tenth of the time of hashing them."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _within(runs: np.ndarray) -> np.ndarray:
    return np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)


def _spelling(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two bytes before, byte, size) of every byte of words and the space that ends each."""
    size = end - begin + 1
    at, inner, low = np.repeat(begin, size) + _within(size), _within(size), _lower(data)
    now = np.where(inner == np.repeat(size - 1, size), 32, low[np.minimum(at, len(data) - 1)]).astype(np.int64)
    back = lambda i: np.where(inner >= i, low[np.maximum(at - i, 0)], 32).astype(np.int64)
    return back(2) * 256 + back(1), now, size


def count_tokens(texts: DataFrame) -> DataFrame:
    """(kind, h, c): how often each token (kind 0) comes, and each byte trigram (kind 1) of the distinct words of a stretch of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1: (np.zeros(0, np.int64), np.zeros(0, np.int64))}
        waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}

        def merge(kind: int) -> None:
            h, c = held[kind]
            fresh, times = np.unique(np.concatenate(waiting[kind]) if waiting[kind] else h[:0], return_counts=True)
            both, at = np.unique(np.concatenate((h, fresh)), return_inverse=True)
            held[kind] = both, np.bincount(at, np.concatenate((c, times)), len(both)).astype(np.int64)
            waiting[kind] = []

        def rows(kind: int) -> pa.RecordBatch:
            h, c = held[kind]
            held[kind] = h[:0], c[:0]
            return pa.record_batch([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(c)], ["kind", "h", "c"])

        for batch in batches:
            for _, data, starts in blocks(batch.column(0), BLOCK):
                h, _, words, at = tokens(data, starts)
                waiting[0].append(h)
                _, own = np.unique(h[at], return_index=True)
                context, now, _ = _spelling(data, words.start[own], words.end[own])
                waiting[1].append(context * 256 + now)
                for kind in (0, 1):
                    if sum(map(len, waiting[kind])) > 1_000_000:
                        merge(kind)
                    if len(held[kind][0]) > 1_000_000:
                        yield rows(kind)
        for kind in (0, 1):
            merge(kind)
            yield rows(kind)

    return texts.mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, node, bit, share): the code of symbol s is bit[first[s]:first[s + 1]] at nodes node[...]; share is each node's part of ones."""
    n = len(weights)
    total = np.concatenate((weights.astype(float), np.zeros(max(n - 1, 0))))
    up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    share = np.full(max(n - 1, 1), 0.5)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = new
        side[j] = 1
        total[new] = a + b
        share[new - n] = b / (a + b)
        heapq.heappush(heap, (a + b, new))
    depth = np.zeros(2 * n - 1, np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[up[i]] + 1
    size = depth[:n]
    first = np.concatenate(([0], np.cumsum(size)))
    node, bit = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.uint8)
    at, place = np.arange(n), first[1:] - 1
    while len(at):
        live = at != 2 * n - 2
        at, place = at[live], place[live]
        node[place], bit[place] = up[at] - n, side[at]
        at, place = up[at], place - 1
    return first, node, bit, np.clip(share, 1e-6, 1 - 1e-6)


@dataclass
class Model:
    top: np.ndarray  # hashes of the symbols, ascending
    symbol: np.ndarray  # their symbols
    base: np.ndarray  # log10 of their base probabilities, by symbol
    info: np.ndarray  # bits of information of each symbol, slots included
    need: float  # bits of a context of the first bit
    shards: int
    n: int  # training tokens and distinct ones
    v: int
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    share: np.ndarray
    tri: np.ndarray  # keys of byte trigrams and their counts, those of their contexts, the plain share of bytes
    tri_n: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    single: np.ndarray
    slot_p: np.ndarray  # probability of each slot by spelling
    slot_n: np.ndarray  # counts of its known words, and what new ones count as
    slot_new: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)  # (classes, nodes) of stretched predictions

    @property
    def size(self) -> int:
        """Number of symbols, slots included."""
        return len(self.top) + RARE

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of tokens; those of rare words are their slots, after all others."""
        n = len(self.top)
        at = np.minimum(np.searchsorted(self.top, h), n - 1)
        return np.where(self.top[at] == h, self.symbol[at], n + (h & (RARE - 1))).astype(np.int32)

    def classes(self, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token in each of the two contexts."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(s < OFTEN, np.arange(len(s)), -1))[:-1]))
        word = np.where(last >= first[row], s[last], OFTEN)
        kind = 1 + (s >= KINDS[0]).astype(np.int64) + (s >= KINDS[1])
        at = np.arange(len(s)) - first[row]
        one = np.where(at > 0, np.concatenate(([0], kind[:-1])), 0)
        two = np.where(at > 1, np.concatenate(([0, 0], kind[:-2]))[: len(s)], 0)
        return word, one * 4 + two

    def places(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Shard and key, in one number, of the first bit's context of each token and its symbol."""
        at = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
        h, known, live = np.zeros(len(s), np.uint64), np.zeros(len(s), np.float32), np.ones(len(s), bool)
        for back in range(1, MOST_WORDS + 1):
            inside = at >= back
            before = np.concatenate((np.zeros(min(back, len(s)), s.dtype), s[:-back]))
            fresh = mix(h + np.where(inside, before + 2, 1).astype(np.uint64))
            h = np.where(live, fresh, h)
            known += np.where(live & inside, self.info[before], 0)
            live &= inside & (known < self.need)
        shard = ((h >> _U(32)) * _U(self.shards)) >> _U(32)
        key = (h & _U((1 << CONTEXT_BITS) - 1)) << _U(SYMBOL_BITS) | s.astype(np.uint64)
        return shard << _U(KEY_BITS) | key

    def spelled(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word's bytes and its end, which is a space, given its slot."""
        context, now, size = _spelling(data, begin, end)
        if not len(size):
            return np.zeros(0)
        p = np.add.reduceat(np.log10(self.byte(context, now)), np.cumsum(size) - size)
        low = _lower(data)
        slot = slot_of(low[begin], np.where(size > 2, low[np.minimum(begin + 1, len(data) - 1)], 32))
        return p - np.log10(self.slot_p[slot])

    def byte(self, context: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Probability of a byte after two others, by trigrams with one count for all bytes."""

        def found(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            return np.where(keys[i] == key, values[i], 0) if len(keys) else np.zeros(len(key))

        return (found(self.tri, self.tri_n, context * 256 + now) + self.single[now]) / (found(self.pair, self.pair_n, context) + 1.0)

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each symbol its code as the high bits of a number and its place in the order of codes; the codes in that order."""
        if not hasattr(self, "_codes"):
            size = np.diff(self.first)
            depth = np.arange(size.sum()) - np.repeat(self.first[:-1], size)
            whole = np.concatenate(([0], np.cumsum(self.bit.astype(np.uint64) << (_U(63) - depth.astype(np.uint64)), dtype=np.uint64))).astype(np.uint64)
            code = whole[self.first[1:]] - whole[self.first[:-1]]
            order = np.argsort(code, kind="stable")
            place = np.empty(len(order), np.uint64)
            place[order] = np.arange(len(order), dtype=np.uint64)
            self._codes = code, place, code[order]
        return self._codes

    # ---- what is left out of pickles and made once in each process

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    def prepare(self) -> Model:
        if not hasattr(self, "plain"):
            size = np.diff(self.first)
            depth = np.arange(size.sum()) - np.repeat(self.first[:-1], size)
            self.deep = np.minimum(depth // 4, _DEPTHS - 1).astype(np.int32)
            p = self.share.astype(np.float32)
            self.plain = np.log(p / (1 - p))
            self.flat = [np.ascontiguousarray(t).ravel() for t in self.tables]
        return self


def tables_of(model: Model, counts: list[np.ndarray]) -> list[np.ndarray]:
    """Stretched predictions at every node for each class, from how often each symbol came there."""
    size, out = np.diff(model.first), []
    one, p = model.bit == 1, model.share
    for table in counts:
        made = np.empty((len(table), len(model.share)), np.float32)
        for k, c in enumerate(table):
            each = np.repeat(c.astype(np.float64), size)
            seen = np.bincount(model.node, each, len(p))
            ones = np.bincount(model.node[one], each[one], len(p))
            made[k] = np.log((ones + SMOOTH * p) / (seen - ones + SMOOTH * (1 - p)))
        out.append(made)
    return out


class Mixer:
    """Scores of the tokens of rows that come in parts; a row that goes on in the next part carries its weights over."""

    def __init__(self, model: Model):
        self.m = model.prepare()
        self.code_w: np.ndarray | None = None
        self.copy_w: np.ndarray | None = None

    def hashed(self, order: np.ndarray, size: np.ndarray, end: np.ndarray, node: np.ndarray, bit: np.ndarray, path: tuple[np.ndarray, ...]) -> np.ndarray:
        """Stretched predictions of the hashed context for every bit; 0 where it was not seen at the bit's node."""
        n, c, many, counts = path
        seen, extra, all_of = n[order], many[order], c[order]
        live = np.where(seen > 0, np.where(all_of > 0, size, np.minimum(extra + 1, size)), 0)  # bits at whose nodes it was seen
        some = np.flatnonzero(live)
        live, at = live[some], _within(live[some])
        place = at + np.repeat((end - size)[some], live)
        # the counts from a token's first bit on, and after its last one
        whole = np.repeat(all_of[some], live + 1)
        first = np.cumsum(live + 1) - live - 1
        whole[first] = seen[some]
        whole[np.repeat(first + 1, extra[some]) + _within(extra[some])] = counts[_ragged(many, order[some])]
        now = at + np.repeat(first, live)
        here, taken, p = whole[now].astype(np.float32), whole[now + 1].astype(np.float32), self.m.share[node[place]].astype(np.float32)
        ones = np.where(bit[place] == 1, taken, here - taken)
        out = np.zeros(len(node), np.float32)
        out[place] = np.log((ones + np.float32(HASHED) * p) / (here - ones + np.float32(HASHED) * (1 - p)))
        return out

    def part(self, s: np.ndarray, first: np.ndarray, classes: tuple[np.ndarray, np.ndarray], usable: np.ndarray, hit: np.ndarray, share: np.ndarray, copy_x: np.ndarray, copy_gate: np.ndarray, goes_on: bool, path: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """log10 of the probability of each token.

        usable: whether the first bit is coded; hit: whether it is set; share: the symbol's part of what followed.
        goes_on: whether the first row is the last part's last one. path: of each token how often its hashed context and it
        in that came, how many counts at inner nodes follow, and these (see paths).
        """
        m, rows = self.m, len(first) - 1
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
        step = (np.arange(len(s)) - first[row]) // STEP
        order = np.argsort(step, kind="stable").astype(np.int32)
        begin = m.first[s[order]]
        size = m.first[s[order] + 1] - begin
        end = np.cumsum(size)
        token = np.repeat(order, size)
        place = np.repeat(begin - (end - size), size)
        place += np.arange(len(place))
        node, bit = m.node.take(place), m.bit.take(place)
        nodes = len(m.share)
        x = [m.plain.take(node)] + [flat.take((c * nodes).take(token) + node) for flat, c in zip(m.flat, classes, strict=True)]
        x.append(self.hashed(order, size, end, node, bit, path) if path else np.zeros(len(node), np.float32))
        steps = -(-np.diff(first) // STEP)
        rank = np.empty(rows, np.int32)  # of rows by their steps, so that those of a step come first
        rank[np.argsort(-steps, kind="stable")] = np.arange(rows, dtype=np.int32)
        going = rows - np.cumsum(np.bincount(steps))
        row = rank[row]
        gate = (row * np.int32(_GATES) + classes[1].astype(np.int32) * np.int32(_DEPTHS)).take(token) + m.deep.take(place)
        new = lambda start, gates: np.repeat(np.array(start, np.float32)[:, None], rows * gates, axis=1)
        w, v = new(CODE_WEIGHTS, _GATES), new(COPY_WEIGHTS, _COPY_GATES)
        if goes_on:
            w[:, rank[0] * _GATES : (rank[0] + 1) * _GATES], v[:, rank[0] * _COPY_GATES : (rank[0] + 1) * _COPY_GATES] = self.code_w, self.copy_w
        coded, copied = np.zeros(len(s)), np.zeros(len(s))
        last = np.flatnonzero(np.diff(step[order], append=-1))
        a, ta = 0, 0
        for tb, b, live in zip((last + 1).tolist(), end[last].tolist(), going[: len(last)].tolist(), strict=True):
            g, y = gate[a:b].astype(np.intp), bit[a:b]
            z = x[0][a:b] * w[0][g]
            for k in (1, 2, 3):
                z += x[k][a:b] * w[k][g]
            p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
            logs = np.log(np.where(y == 1, p, 1 - p))
            own = order[ta:tb]
            cuts = (end[ta:tb] - size[ta:tb]) - a
            some = size[ta:tb] > 0
            coded[own[some]] = np.add.reduceat(logs, cuts[some]) if some.any() else 0
            use = own[usable[own]]
            cg = row[use] * np.int32(_COPY_GATES) + copy_gate[use]
            q = np.clip(1 / (1 + np.exp(-(copy_x[:, use] * v[:, cg]).sum(axis=0))), 1e-4, 1 - 1e-4)
            copied[use] = q
            err = np.float32(CODE_RATE) * (y - p)
            many = np.sqrt(np.maximum(np.bincount(g, minlength=live * _GATES), 1))
            for k in range(4):
                w[k, : live * _GATES] += np.bincount(g, err * x[k][a:b], live * _GATES) / many
            err = np.float32(COPY_RATE) * (hit[use] - q)
            for k in range(len(v)):
                v[k, : live * _COPY_GATES] += np.bincount(cg, err * copy_x[k, use], live * _COPY_GATES)
            a, ta = b, tb
        self.code_w, self.copy_w = w[:, rank[-1] * _GATES :][:, :_GATES].copy(), v[:, rank[-1] * _COPY_GATES :][:, :_COPY_GATES].copy()
        return np.log10(copied * share + (1 - copied) * np.exp(coded))


def first_bits(row: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(usable, hit, predictions, gate) of the first bits of tokens: n and c say how often their context and they in it came in other texts."""
    usable, hit = n > 0, c > 0
    use = np.flatnonzero(usable)
    x, gate = np.zeros((3, len(n)), np.float32), np.zeros(len(n), np.int32)
    if not len(use):
        return usable, hit, x, gate
    r, h = row[use], hit[use].astype(np.int64)
    begin = np.concatenate(([True], r[1:] != r[:-1]))
    start = np.maximum.accumulate(np.where(begin, np.arange(len(r)), 0))  # the first usable token of the row
    sums = np.concatenate(([0], np.cumsum(h)))
    i = np.arange(len(r))

    def lately(many: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.maximum(i - many, start)
        return sums[i] - sums[lo], i - lo

    stretch = lambda hits, seen, prior, strength: np.log((hits + prior * strength) / (seen - hits + (1 - prior) * strength))
    x[0, use] = stretch(*lately(4), 0.2, 1.0)
    x[1, use] = stretch(*lately(24), 0.1, 1.0)
    kind = (n[use] > 1).astype(np.int64) + (n[use] > 3)
    for k in range(3):  # what came true for contexts that were seen as often
        own = kind == k
        upto, of = np.concatenate(([0], np.cumsum(own & (h == 1)))), np.concatenate(([0], np.cumsum(own)))
        x[2, use[own]] = stretch(upto[i] - upto[start], of[i] - of[start], 0.15, 1.0)[own]
    before = np.where(begin, 0, np.concatenate(([0], 1 + h[:-1])))
    gate[use] = kind * 3 + before
    return usable, hit, x, gate


# ---- arrays that travel between blocks and shards


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each as zstd over their bytes by place."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
        data = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out += [len(x).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def _arrays_of(data: bytes) -> int:
    """How many arrays pack put together."""
    n, at = 0, 0
    while at < len(data):
        n, at = n + 1, at + 16 + int.from_bytes(data[at + 8 : at + 16], "little")
    return n


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of pack, by their types."""
    out, at = [], 0
    for kind in kinds.split():
        n, size, width = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little"), np.dtype(kind).itemsize
        raw = pa.decompress(data[at + 16 : at + 16 + size], n * width, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 16 + size
    return out


def pack_keys(keys: np.ndarray, times: np.ndarray, wide: bool = False) -> bytes:
    """Ascending keys and how often each comes. Those below 2 ** KEY_BITS go as counts by their high bits and their low 32 bits."""
    large = np.flatnonzero(times > 254)
    high = b"" if wide else pack(np.bincount((keys >> _U(32)).astype(np.int64), minlength=1 << (KEY_BITS - 32)).astype("<u4"))
    head = np.array([len(keys), len(large), wide, len(high)], "<u4")
    own = keys.astype("<u8") if wide else (keys & _U(0xFFFFFFFF)).astype("<u4")
    return head.tobytes() + high + b"".join(x.tobytes() for x in (own, np.minimum(times, 255).astype(np.uint8), large.astype("<u4"), times[large].astype("<u8")))


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n, k, wide, size), at = np.frombuffer(data, "<u4", 4).tolist(), 16

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, many, at)
        at += x.nbytes
        return x

    if wide:
        keys = take("<u8", n)
    else:
        high = unpack(data[at : at + size], "<u4")[0]
        at += size
        keys = np.repeat(np.arange(len(high), dtype=np.uint64), high) << _U(32) | take("<u4", n)
    times = take("u1", n).astype(np.int64)
    large = take("<u4", k)
    times[large] = take("<u8", k)
    return keys, times


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Runs of rows with one value of a column, over the bounds of batches."""
    rows: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):  # not the whole batch at once, which is all that a task reads
            r = batch.slice(i, 1).to_pylist()[0]
            if rows and rows[0][column] != r[column]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows
    pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it holds


def paths(context: np.ndarray, code: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a context came with symbols below each inner node of a symbol's code, from the first bit on: (how many, counts).

    Entries are distinct and ascend by context and code; c says how often each came. Counts fall along a code, and end
    where only the entry's own is left.
    """
    differ = code[1:] ^ code[:-1]
    top = differ & ~(differ >> _U(1))  # no rounding reaches the next power of two
    common = np.concatenate(([-1], np.where(context[1:] == context[:-1], 64 - np.frexp(top.astype(np.float64))[1], -1)))[: len(c)]
    at, level, found = np.arange(len(c), dtype=np.int32), 0, []
    while len(at):
        begin = common[at] < level
        begin[0] = True
        edge = np.flatnonzero(begin)
        group, own = np.cumsum(begin) - 1, c[at]
        seen = np.add.reduceat(own, edge)[group]
        live = seen > own
        if level:
            found.append((at[live], np.minimum(seen[live], 0xFFFFFFFF).astype("<u4")))
        at = at[np.logical_or.reduceat(live, edge)[group]]
        level += 1
    which, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, at.astype("<u4"))
    return np.bincount(which, minlength=len(c)), counts[np.argsort(which, kind="stable")]


def _ragged(many: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the runs, of lengths many, that which names."""
    return np.repeat((np.cumsum(many) - many)[which], many[which]) + _within(many[which])


def served(chunks: list[bytes], model: Model | None = None) -> list[bytes]:
    """For each chunk of keys of one shard, how often each key and each context came in all of them; with a model, also paths."""
    keys, times = (list(x) for x in zip(*map(unpack_keys, chunks), strict=True))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    every, n = np.concatenate(keys), np.concatenate(times)
    del keys, times
    low = _U((1 << SYMBOL_BITS) - 1)
    if model:
        _, place, codes = model.codes()
        every = (every & ~low) | place[(every & low).astype(np.int64)]
    order = np.argsort(every)
    ascending, n = every[order], n[order]
    out = []
    for x in (ascending, ascending >> _U(SYMBOL_BITS)):
        begin = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
        total = np.add.reduceat(n, np.flatnonzero(begin)) if len(x) else n
        back = np.empty(len(x), "<u4")
        back[order] = np.minimum(total, 0xFFFFFFFF)[np.cumsum(begin) - 1] if len(x) else 0
        out.append(np.split(back, cuts))
        if model and len(out) == 1 and len(x):
            one = x[begin]
            many, counts = paths(one >> _U(SYMBOL_BITS), codes[(one & low).astype(np.int64)], total)
            which = np.empty(len(x), np.int64)
            which[order] = np.cumsum(begin) - 1
    if not model or not len(every):
        return [pack(a, b) for a, b in zip(*out, strict=True)]
    return [pack(a, b, many[w].astype("u1"), counts[_ragged(many, w)]) for a, b, w in zip(*out, np.split(which, cuts), strict=True)]


def without_own(model: Model, path: tuple[np.ndarray, ...], context: np.ndarray, row: np.ndarray, s: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths of tokens less what their own row, if it is a training one, has of each count."""
    n, c, many, counts = path
    group, which, times = np.unique(context.astype(np.int64) * (int(row[-1]) + 1) + row, return_inverse=True, return_counts=True)
    own_n, own_c, own_many, own_counts = np.where(learnt, 1, 0), np.where(learnt, 1, 0), np.zeros(len(n), np.int64), np.zeros(0, np.int64)
    some = np.flatnonzero(learnt & (times[which] > 1))  # others come once in their row, at every node
    if len(some):
        _, place, codes = model.codes()
        key, at, c_of = np.unique(which[some].astype(np.uint64) << _U(SYMBOL_BITS) | place[s[some]], return_inverse=True, return_counts=True)
        m, own = paths(key >> _U(SYMBOL_BITS), codes[(key & _U((1 << SYMBOL_BITS) - 1)).astype(np.int64)], c_of)
        own_n[some], own_c[some], own_many[some] = times[which[some]], c_of[at], m[at]
        own_counts = own[_ragged(m, at)]
    # the row's own path is no longer than the whole one, as what the row has beside a token is in that too
    mine = np.repeat(own_c.astype(counts.dtype), many)
    mine[np.repeat(np.cumsum(many) - many, own_many) + _within(own_many)] = own_counts
    return np.maximum(n - own_n, 0), np.maximum(c - own_c, 0), many, counts - np.minimum(counts, mine)


def _own(which: np.ndarray, times: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How often what each token shows (which, an index into times) comes in the token's row; times: how often in the block."""
    out = np.ones(len(which), np.int64)
    some = np.flatnonzero(times[which] > 1)
    if len(some):
        _, at, n = np.unique(which[some] * rows + row[some], return_inverse=True, return_counts=True)
        out[some] = n[at]
    return out


#: Types of a block's arrays: key, whether it is null, whether it is held out, bytes, tokens; symbols; hashes and spellings of its rare tokens.
BLOCK_KINDS = "<i8 u1 u1 <i8 <u4 <i4 <u8 <f4"


def asked(model: Model, data: bytes) -> Iterator[tuple[int, bytes]]:
    """(shard, keys) that a block needs: contexts with their symbols, and then hashes of rare words, in shards of their own."""
    _, _, held, _, sizes, s, rare, _ = unpack(data, BLOCK_KINDS)
    learnt = np.repeat(held == 0, sizes)
    place = model.places(s, np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))))
    is_rare = s >= len(model.top)
    for at, known, wide in ((place, learnt, False), (rare, learnt[is_rare], True)):
        keys = _distinct(at)
        if not len(keys):
            continue
        own = np.sort(at[known])
        times = np.diff(np.searchsorted(own, keys), append=len(own))
        shard = _shard_of_word(model, keys) if wide else keys >> _U(KEY_BITS)
        if wide:
            order = np.argsort(shard, kind="stable")
            keys, times, shard = keys[order], times[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            yield int(shard[a]), pack_keys(keys[a:b] if wide else keys[a:b] & _U((1 << KEY_BITS) - 1), times[a:b], wide)


def _shard_of_word(model: Model, h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> _U(32)) * _U(model.shards) >> _U(32)) + _U(model.shards)


def scored_block(model: Model, data: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """SCORES of a block's rows; answers: what each shard says of the block's keys, in the order of shards."""
    key, no_key, held, size_b, sizes, s, rare, spelled = unpack(data, BLOCK_KINDS)
    sizes, rows = sizes.astype(np.int64), len(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(rows), sizes)
    keys, which, times = np.unique(model.places(s, first), return_inverse=True, return_counts=True)
    kinds = "<u4 <u4 u1 <u4"
    told = [unpack(x, kinds) if _arrays_of(x) == 4 else [*unpack(x, "<u4 <u4"), None, None] for shard, x in answers if shard < model.shards]
    c, n = (np.concatenate([np.zeros(0, "<u4"), *[t[i] for t in told]]).astype(np.int64)[which] for i in (0, 1))
    context = np.cumsum(np.concatenate(([0], (np.diff(keys >> _U(SYMBOL_BITS)) > 0).astype(np.int64))))[which] if len(keys) else which
    learnt, path = held[row] == 0, None
    if told and all(t[2] is not None for t in told):
        many = np.concatenate([t[2] for t in told]).astype(np.int64)
        counts = np.concatenate([t[3] for t in told])
        del told
        path = without_own(model, (n, c, many[which], counts[_ragged(many, which)]), context, row, s, learnt)
        n, c = path[:2]
        del many, counts
    else:
        c = np.maximum(c - np.where(learnt, _own(which, times, row, rows), 0), 0)
        n = np.maximum(n - np.where(learnt, _own(context, np.bincount(context), row, rows), 0), 0)
    path_end = np.concatenate(([0], np.cumsum(path[2]))) if path else None
    del keys, which, times, context
    usable, hit, x, gate = first_bits(row, n, c)
    share = np.where(usable, c / np.maximum(n, 1), 0.0)
    classes = model.classes(s, first)
    score, mixer, a, goes_on = np.zeros(rows), Mixer(model), 0, False
    while a < len(s):
        r = row[a]
        whole = int(np.searchsorted(first, a + PART, "right")) - 1  # rows that end within the part
        b = int(first[whole]) if first[whole] > a else min(int(first[r + 1]), a + PART)
        own = slice(a, b)
        edges = np.concatenate(([a], first[(first > a) & (first < b)], [b])) - a
        got = mixer.part(s[own], edges, tuple(k[own] for k in classes), usable[own], hit[own], share[own], x[:, own], gate[own], goes_on, path and (n[own], c[own], path[2][own], path[3][path_end[a] : path_end[b]]))
        score += np.bincount(row[own], got, rows)
        goes_on = b < len(s) and first[row[b]] != b
        a = b
    is_top = s < len(model.top)
    base, known = np.bincount(row[is_top], model.base[s[is_top]], rows), np.bincount(row[is_top], minlength=rows) * (model.n > 0)
    if len(rare):
        own, slot = row[~is_top], s[~is_top] - len(model.top)
        words, which = np.unique(rare, return_inverse=True)
        order = np.argsort(_shard_of_word(model, words), kind="stable")
        count = np.empty(len(words), np.int64)
        count[order] = np.concatenate([unpack(x, "<u4 <u4")[0] for shard, x in answers if shard >= model.shards])
        c = count[which]
        inner = np.log10(np.where(c > 0, c, model.slot_new[slot]) / (model.slot_n[slot] + model.slot_new[slot])) + np.where(c > 0, 0, spelled)
        score += np.bincount(own, inner, rows)
        base += np.bincount(own, np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1))), rows)
        known = known + np.bincount(own[c > 0], minlength=rows)
    bits = -score * np.log2(10) / np.maximum(size_b, 1)
    return pa.record_batch([pa.array(key, mask=no_key == 1), pa.array(held == 1), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(np.full(rows, model.n)), pa.array(base), pa.array(score), pa.array(bits)], [c.split()[0] for c in SCORES.split(", ")])


# ---- learning and scoring


def learn(ws: Workspace, texts: DataFrame) -> Model:
    """The model of training texts, yet without tables."""
    counted = ws.keep(count_tokens(texts), "counts")
    counts = counted.where("kind = 0").select("h", "c")
    n, v, once, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.max(F.when(F.col("h") == END, F.col("c")))).first()
    top = counts.orderBy(F.col("c").desc(), "h").limit(TOP).toArrow()  # TOP rows at most
    hashes, times = top.column("h").to_numpy(), top.column("c").to_numpy().astype(float)
    if END not in hashes:
        hashes, times = np.append(hashes[: TOP - 1], END), np.append(times[: TOP - 1], ends or 1.0)
    slot = F.col("h").bitwiseAND(F.lit(RARE - 1)).cast("int").alias("slot")
    total = np.zeros(RARE)
    for r in counts.where(F.col("h") != END).groupBy(slot).agg(F.sum("c").alias("c")).collect():  # RARE rows at most
        total[r["slot"]] = r["c"]
    words = hashes != END
    total = np.maximum(total - np.bincount(hashes[words] & (RARE - 1), times[words], RARE), 0)
    grams = counted.where("kind = 1").select("h", "c").toArrow().sort_by("h")  # trigrams of bytes, 256 ** 3 at most
    tri, tri_n = grams.column("h").to_numpy(), grams.column("c").to_numpy().astype(np.float64)
    pair, at = np.unique(tri >> 8, return_inverse=True)
    plain = np.bincount(tri & 255, tri_n, 256) + 1
    order = np.argsort(hashes)
    model = Model(
        top=hashes[order], symbol=order, base=np.log10((times * (n > 0) + 0.1) / (n + 0.1 * (v + 1))), info=np.zeros(0), need=float(np.log2(max(n, 2)) + EXTRA), shards=max(1, n >> SHARD), n=int(n), v=int(v),
        first=np.zeros(0), node=np.zeros(0), bit=np.zeros(0), share=np.zeros(0), tri=tri, tri_n=tri_n, pair=pair, pair_n=np.bincount(at, tri_n, len(pair)), single=plain / plain.sum(), slot_p=np.ones(RARE), slot_n=total, slot_new=np.ones(RARE),
    )
    b1, b2 = (x.ravel() for x in np.meshgrid(np.arange(256), np.arange(256), indexing="ij"))
    both = model.byte(np.full(len(b1), 32 * 256 + 32), b1) * model.byte(32 * 256 + b1, b2)
    model.slot_p = np.maximum(np.bincount(slot_of(b1, b2), both, RARE), 1e-12)
    model.slot_new = 0.5 + once * model.slot_p
    weights = np.concatenate((np.maximum(times, 1), total + model.slot_new))
    model.info = np.log2(weights.sum() / weights).astype(np.float32)
    model.first, model.node, model.bit, model.share = huffman(weights)
    return model


WORK = "block long, data binary, task int, tab int, class int, seen binary"
SCORES = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _work(block: int | None = None, data: bytes | None = None, task: int | None = None, tab: int | None = None, kind: int | None = None, seen: bytes | None = None) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([data], pa.binary()), *[pa.array([x], pa.int32()) for x in (task, tab, kind)], pa.array([seen], pa.binary())], [c.split()[0] for c in WORK.split(", ")])


def coded(ws: Workspace, docs: DataFrame, model: Model, key: str, text: str, held_out) -> DataFrame:
    """WORK: each block's arrays, and how often each symbol came in each class in a task's training rows."""
    sent = ws.spark.sparkContext.broadcast(model)  # TOP and RARE bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task = sent.value, TaskContext.get().partitionId()
        block, waiting = task << 20, 0
        seen = [np.zeros(k * m.size, np.uint32) for k in CLASSES]
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, block, waiting
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            _, _, out, _, sizes, s, _, _ = arrays
            learnt = np.repeat(out == 0, sizes)
            for table, k in zip(seen, m.classes(s, np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))), strict=True):
                at, times = np.unique(k[learnt] * m.size + s[learnt], return_counts=True)
                table[at] += times.astype(np.uint32)
            made = _work(block, pack(*[x.astype(k) for x, k in zip(arrays, BLOCK_KINDS.split(), strict=True)]))
            held, block, waiting = [], block + 1, 0
            return made

        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy()
            no_key, out = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, data, starts in blocks(batch.column(2), BLOCK):
                own = slice(row, row + len(starts) - 1)
                h, first, words, at = tokens(data, starts)
                s = m.symbols(h)
                rare = s[at] >= len(m.top)
                hashes = h[at[rare]]
                _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
                where = np.flatnonzero(rare)[one]
                spelled = m.spelled(data, words.start[where], words.end[where])[which]
                held.append((keys[own], no_key[own], out[own], np.diff(starts) - 1, np.diff(first), s, hashes.view(np.uint64), spelled))
                waiting += len(s)
                if waiting >= TOKENS:
                    yield flush()
        if held:
            yield flush()
        for tab, (table, many) in enumerate(zip(seen, CLASSES, strict=True)):
            for k, c in enumerate(table.reshape(many, -1)):
                at = np.flatnonzero(c)
                if len(at):
                    yield _work(task=task, tab=tab, kind=k, seen=pack(np.diff(at, prepend=0).astype("<u4"), c[at].astype("<u8")))

    rows = docs.select(F.col(key).cast("long").alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    out = ws.keep(rows.mapInArrow(run, WORK), "coded")
    sent.unpersist()
    return out


def _add(data: bytes, out: np.ndarray) -> None:
    gaps, c = unpack(data, "<u4 <u8")
    out[np.cumsum(gaps.astype(np.int64))] += c.astype(out.dtype)


def class_counts(ws: Workspace, work: DataFrame, size: int) -> list[np.ndarray]:
    """How often each symbol came in each class, summed over tasks in groups first, so that no task reads from all of them at once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.uint64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            data = pack(np.diff(at, prepend=0).astype("<u4"), total[at].astype("<u8"))
            total[:] = 0
            return pa.record_batch([*[pa.array([x], pa.int32()) for x in now], pa.array([data])], ["tab", "class", "task", "seen"])

        for batch in batches:
            for r in batch.to_pylist():
                if (k := (r["tab"], r["class"], r["task"])) != now:
                    if now is not None:
                        yield done()
                    now = k
                _add(r["seen"], total)
        if now is not None:
            yield done()

    schema, keys = "tab int, class int, task int, seen binary", ["tab", "class", "task"]
    rows = work.where("seen IS NOT NULL").select("tab", "class", (F.col("task") % 64).cast("int").alias("task"), "seen")
    for group in (F.col("task"), F.lit(0)):
        rows = rows.withColumn("task", group).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "seen").mapInArrow(add, schema)
    out = [np.zeros((k, size), np.float32) for k in CLASSES]
    for r in ws.keep(rows, "classes").toLocalIterator():  # the classes' number bounds the rows, that of symbols each row
        _add(r["seen"], out[r["tab"]][r["class"]])
    return out


def score(ws: Workspace, docs: DataFrame, key: str, text: str, held_out) -> DataFrame:
    """SCORES of every row of docs."""
    model = learn(ws, docs.where(~held_out).select(F.col(text).alias("text")))
    work = coded(ws, docs, model, key, text, held_out)
    light = ws.spark.sparkContext.broadcast(model)  # as it is here, without the tables, which only scores need
    model.tables = tables_of(model, class_counts(ws, work, model.size))
    sent = ws.spark.sparkContext.broadcast(model)  # TOP, RARE and CLASSES bound it

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = list(zip(*asked(light.value, r["data"]), strict=True))
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array([r["block"]] * len(out[0])), pa.array(out[1], pa.binary())], ["shard", "block", "data"])

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, "shard"):
            out = served([r.pop("data") for r in rows], light.value if rows[0]["shard"] < light.value.shards else None)
            yield pa.record_batch([pa.array([r["shard"] for r in rows]), pa.array([r["block"] for r in rows]), pa.array(out, pa.binary())], ["shard", "block", "data"])

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, "block"):
            yield scored_block(sent.value, rows[0]["data"], [(r["shard"], r["data"]) for r in rows[1:]])

    schema = "shard long, block long, data binary"
    own = work.where("block IS NOT NULL").select("block", "data")
    answers = own.mapInArrow(ask, schema).repartition("shard").sortWithinPartitions("shard").mapInArrow(serve, schema)
    both = answers.unionByName(own.withColumn("shard", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(score_rows, SCORES)
