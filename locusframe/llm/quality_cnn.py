"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

Bytes are embedded, and learned filters run over overlapping chunks of the whole document: short ones of 8 bytes, which
see letters and signs, and wide ones of 64 bytes, which see how words follow each other, or that one is said again and
again. Chunks of a bank start at every half of their width, so a chunk's response is the sum of two halves and all
chunks of a block are one matrix product over its bytes. Each filter keeps its highest response of the document; a layer
of HIDDEN units and a logistic one combine them into one probability. Wide filters start as waves of many lengths, as
text that repeats itself has a period; all are learned.

Gradients reach only the chunk that holds a filter's highest response, so learning is cheap. A text longer than SEGMENT
bytes is read in segments, whose highest responses are joined, so memory doesn't grow with a text beyond its own bytes.

Null texts are empty; an empty text is one chunk of padding and has a score like any other. Rows are scored one by one,
repeated rows alike. Without labels of both kinds every score is the labels' mean, or 0.5 without any. Empty tables
give no rows. Names of docs' other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from . import labelled
from .texts import blocks
from .token_ids import forget

DIM, HIDDEN = 8, 16
#: Width in bytes and number of the filters of each bank.
BANKS = ((8, 24), (64, 48))
#: Longest and shortest period, in bytes, of the waves that wide filters start as.
PERIODS = (24, 2)
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
BLOCK = 1 << 18
#: Bytes of a text that are read at a time; a multiple of every width.
SEGMENT = 1 << 20
#: Labelled texts to learn from at most, and the longest of them in bytes: what comes to the driver is their product at most.
MOST_TEXTS, LONGEST_LEARNT = 2400, 1 << 16


def chunked(data: np.ndarray, starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a block with each row padded by zeros to whole steps and one more, and the first step of each row and the end."""
    size = np.diff(starts) - 1
    steps = -(-size // step) + 1 + (size == 0)
    first = np.concatenate(([0], np.cumsum(steps)))
    out = np.zeros(first[-1] * step, np.uint8)
    to = np.repeat(first[:-1] * step - starts[:-1], np.diff(starts)) + np.arange(len(data))
    own = np.ones(len(data), bool)
    own[starts[1:] - 1] = False  # the space after each text
    out[to[own]] = data[own]
    return out, first


@dataclass
class Network:
    """byte: values of bytes, zeros for the padding; filters and offsets of each bank; the two layers after them."""

    byte: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    bias: float

    def responses(self, bank: int, data: np.ndarray, starts: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(responses of all chunks, padded bytes, first step of each row and the end); goes_on: the last row has more bytes than these."""
        width, filters = BANKS[bank][0], self.filters[bank]
        padded, first = chunked(data, starts, width // 2)
        half, n = len(filters) // 2, filters.shape[1]
        both = self.byte[padded].reshape(-1, half) @ np.concatenate((filters[:half], filters[half:]), axis=1)
        at = both[:, :n].copy()
        at[:-1] += both[1:, n:]
        at[first[1:] - 1] = -np.inf  # a chunk that starts at a row's last step would reach into the next
        if goes_on:
            at[-2] = -np.inf  # the next segment holds all of it
        return at, padded, first

    def tops(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each row."""
        if len(starts) == 2 and starts[1] - 1 > SEGMENT:
            parts, end = [], starts[1] - 1
            for a in range(0, end, SEGMENT):
                out = []
                for bank, (width, _) in enumerate(BANKS):
                    own = data[a : min(a + SEGMENT + width // 2, end)]
                    at, _, _ = self.responses(bank, np.append(own, 32), np.array([0, len(own) + 1]), goes_on=a + SEGMENT + width // 2 <= end)
                    out.append(at.max(axis=0))
                parts.append(np.concatenate(out))
            high = np.max(parts, axis=0)[None]
        else:
            out = []
            for bank in range(len(BANKS)):
                at, _, first = self.responses(bank, data, starts)
                out.append(np.maximum.reduceat(at, first[:-1], axis=0))
            high = np.concatenate(out, axis=1)
        return np.maximum(high + np.concatenate(self.offsets), 0)

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = np.tanh(self.tops(data, starts).astype(np.float64) @ self.inner + self.inner_bias) @ self.outer + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def start(rng: np.random.Generator, share: float) -> dict[str, np.ndarray]:
    """Parameters before learning."""
    n = sum(f for _, f in BANKS)
    p = {"byte": rng.normal(0, 0.5, (256, DIM)), "inner": rng.normal(0, 0.2, (n, HIDDEN)), "inner_bias": np.zeros(HIDDEN), "outer": rng.normal(0, 0.3, HIDDEN), "bias": np.array(np.log(share / (1 - share)))}
    (short, n_short), (wide, n_wide) = BANKS
    p["filters0"] = rng.normal(0, 0.2, (short * DIM, n_short))
    rate = np.linspace(1 / PERIODS[0], 1 / PERIODS[1], n_wide // 2).repeat(2)
    wave = np.cos(2 * np.pi * np.arange(wide)[:, None] * rate + np.pi / 2 * (np.arange(n_wide) % 2))
    p["filters1"] = (wave[:, None, :] * rng.normal(0, 0.1, (1, DIM, n_wide))).reshape(wide * DIM, n_wide)
    return p | {f"offsets{i}": np.zeros(f) for i, (_, f) in enumerate(BANKS)}


def network(p: dict[str, np.ndarray]) -> Network:
    byte = p["byte"].astype(np.float32)
    byte[0] = 0
    f = lambda name: [p[f"{name}{i}"].astype(np.float32) for i in range(len(BANKS))]
    return Network(byte, f("filters"), f("offsets"), p["inner"], p["inner_bias"], p["outer"], float(p["bias"]))


def constant(share: float | None) -> Network:
    s = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    return network({k: x if k == "bias" else np.zeros_like(x) for k, x in start(np.random.default_rng(0), s).items()})


def _highest(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chunk with the highest response of each row and filter."""
    return np.stack([a + np.argmax(at[a:b], axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])


def gradients(p: dict[str, np.ndarray], net: Network, data: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of a batch."""
    runs = [net.responses(i, data, starts) for i in range(len(BANKS))]
    best = [_highest(at, first) for at, _, first in runs]
    top = np.maximum(np.concatenate([np.take_along_axis(at, h, 0) for (at, _, _), h in zip(runs, best, strict=True)], axis=1) + np.concatenate(net.offsets), 0).astype(np.float64)
    hidden = np.tanh(top @ p["inner"] + p["inner_bias"])
    error = (1 / (1 + np.exp(-np.clip(hidden @ p["outer"] + p["bias"], -500, 500))) - y) / len(y)
    down = error[:, None] * p["outer"] * (1 - hidden * hidden)
    g = {"outer": hidden.T @ error, "bias": error.sum(), "inner": top.T @ down + DECAY * p["inner"], "inner_bias": down.sum(axis=0), "byte": np.zeros((256, DIM))}
    back, at = ((down @ p["inner"].T) * (top > 0)).astype(np.float32), 0
    for i, ((width, n), (_, padded, _), h) in enumerate(zip(BANKS, runs, best, strict=True)):
        own, filters = back[:, at : at + n], net.filters[i].reshape(width, DIM, n)
        at += n
        chunk = padded[(h * (width // 2))[..., None] + np.arange(width)]  # (rows, filters, width)
        seen = net.byte[chunk]
        g[f"offsets{i}"] = own.sum(axis=0)
        g[f"filters{i}"] = (seen * own[..., None, None]).sum(axis=0).transpose(1, 2, 0).reshape(width * DIM, n)
        flat = chunk.ravel()
        for d in range(DIM):
            g["byte"][:, d] += np.bincount(flat, (own[..., None] * filters[:, d].T[None]).ravel(), 256)
    return g


def fit(texts: list[bytes], y: np.ndarray, seed: int = 3) -> Network:
    """A network for probabilities of y by Adam on the logistic loss."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else None)
    rng = np.random.default_rng(seed)
    p = start(rng, float(y.mean()))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            data = np.frombuffer(b"".join(texts[j] + b" " for j in own), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(texts[j]) + 1 for j in own])))
            g = gradients(p, network(p), data, starts, y[own])
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return network(p)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network from the bounded sample of labelled rows, whose whole texts come to the driver; longer ones than LONGEST_LEARNT are left out of learning."""
    short = docs.select(key, text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= LONGEST_LEARNT)
    found = labelled.sample(short, labels.select(key, label), key, label, MOST_TEXTS).select(key, text, "__label").collect()
    found.sort(key=lambda r: r[0])
    return fit([(r[1] or "").encode() for r in found], np.array([r[2] for r in found], float))


def classify(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    have = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row, data, starts in blocks(batch.column(1), BLOCK):
                yield pa.record_batch([batch.column(0)[row : row + len(starts) - 1], pa.array(network.score(data, starts))], [key, "score"])

    ship(docs.sparkSession)
    return have.mapInArrow(run, f"`{key}` {have.dtypes[0][1]}, score double")


def filter_docs(docs: DataFrame, network: Network, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `least`, with docs' own columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row, data, starts in blocks(batch.column(at), BLOCK):
                yield batch.slice(row, len(starts) - 1).filter(pa.array(network.score(data, starts) >= least))

    ship(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
