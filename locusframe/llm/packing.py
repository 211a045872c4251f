"""Sum-of-squares packing (Csirik, Johnson, Kenyon, Orlin, Shor and Weber) of tokenized documents into windows.

A document's whole windows are cut off first; what is left goes, as it comes, to the fill level that makes the
sum of squares of the numbers of open windows at each level least, an empty window being level 0. Each
partition of the input packs its own rows, with an array of level counts. The pieces of the windows that are open at its
end, some two hundred of them however many rows there were, are written beside the others and packed once more in the
same way with those of other partitions, LEFT tokens to a task and the longest first. Only what is open then is filled up with cuts,
and its last window cut at powers of two, which need no padding; so no sequence is padded.

Windows that no piece fits, of lengths that don't combine, stay open, so their number has no bound of its own: when open windows hold OPEN
tokens their pieces are handed on too, or, in the second packing, filled up. A lost task packs the same rows again in the
same way: rows come from files, and in the second packing in the order of their lengths and keys.

Null and empty texts have the end id alone. Null and repeated keys are packed like others. Empty tables give no rows. A text's
ids and the bytes of a row must fit Spark's rows of 2 GB, as for any column of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .shared import Workspace
from .token_ids import encoder, give_back

END = 1
WIDTH = 2048
#: Bytes of text that are encoded at a time, fewer than the encoder's own, as windows take memory too.
BLOCK = 1 << 20
#: Tokens that open windows hold at most, and tokens of the second packing for each of its tasks.
OPEN, LEFT = 1 << 23, 1 << 23
#: Number of the first sequence of the second packing's partitions, in partitions.
AFTER = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Pieces are [key, start, ids, doc_tokens]; closed sequences are lists of pieces, in closed."""

    def __init__(self, width: int = WIDTH):
        self.width, self.held = width, 0
        self.count = np.zeros(width + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(width + 1)]
        self.closed: list[list] = []

    def level(self, size: int) -> int:
        """The fill level that a piece of size best joins; the fullest of equals."""
        n, fits = self.count, self.width - size
        change = np.where(n[: fits + 1] > 0, 1 - 2 * n[: fits + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        after = 2 * n[size : self.width + 1] + 1
        after[-1] = 0  # a full window is not open
        return fits - int(np.argmin((change + after)[::-1]))

    def put(self, piece: list, level: int) -> None:
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        self.held += len(piece[2]) // 4
        level += len(piece[2]) // 4
        if level == self.width:
            self.closed.append(window)
            self.held -= self.width
        else:
            self.open[level].append(window)
            self.count[level] += 1

    def add(self, key: int | None, ids: bytes) -> None:
        """A whole document."""
        total, at, step = len(ids) // 4, 0, self.width * 4
        while len(ids) - at >= step:
            self.closed.append([[key, at // 4, ids[at : at + step], total]])
            at += step
        if at < len(ids):
            self.join([key, at // 4, ids[at:], total])

    def join(self, piece: list) -> None:
        """A piece shorter than a window."""
        self.put(piece, self.level(len(piece[2]) // 4))

    def leave(self) -> list[list]:
        """The pieces of all open windows, the fullest last; no window is open after it."""
        pieces = [p for at in self.open for w in at for p in w]
        self.count[:] = 0
        self.open, self.held = [[] for _ in range(self.width + 1)], 0
        return pieces

    def finish(self) -> None:
        """Closes all windows: the fullest are filled with pieces of the emptiest, the last is cut at powers of two."""
        pieces = self.leave()
        size = sum(len(p[2]) for p in pieces) // 4
        powers = [1 << i for i in range(self.width.bit_length() - 1, -1, -1)]
        shapes = [self.width] * (size // self.width) + [p for p in powers if size % self.width & p]
        pieces.reverse()
        for shape in shapes:
            window, room = [], shape * 4
            while room:
                key, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append([key, start + room // 4, ids[room:], total])
                    ids = ids[:room]
                window.append([key, start, ids, total])
                room -= len(ids)
            self.closed.append(window)


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, width: int = WIDTH, ids: bool = True) -> DataFrame:
    """PIECES of all docs: one row for each piece, which lies in its sequence at offset; ids only if asked for.

    Sequences are numbered within their partition, from the partition's number times 2 ** 33; those of the second packing
    come after, from AFTER partitions on.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def rows(windows: list[list], number: int, left: bool) -> pa.RecordBatch:
        out = []
        for window in windows:
            offset = 0
            for k, start, part, total in window:
                out.append((k, start, len(part) // 4, zlib.crc32(part), total, number, offset, part if ids or left else None, left))
                offset += len(part) // 4
            number += 1
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [*names, "left_over"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder.cache_info().currsize:  # a worker that served another operator before
            give_back()
        e, packer, number = encoder(tokenizer), Packer(width), TaskContext.get().partitionId() << 33

        def closed() -> pa.RecordBatch:
            nonlocal number
            batch, packer.closed, number = rows(packer.closed, number, False), [], number + len(packer.closed)
            return batch

        def open_() -> pa.RecordBatch:
            return rows([[p] for p in packer.leave()], 0, True)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, found in e.rows(batch.column(1), END, BLOCK):
                packer.add(keys[i], found)
                if packer.held >= OPEN:
                    yield open_()
                if i % 512 == 511:
                    yield closed()
            yield closed()
        yield open_()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(width), AFTER + TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packer.join(list(piece))
                if packer.held >= OPEN:
                    packer.finish()
            yield rows(packer.closed, number, False)
            number, packer.closed = number + len(packer.closed), []
        packer.finish()
        yield rows(packer.closed, number, False)

    ship(spark)
    kept = PIECES + ", left_over boolean"
    packed = ws.keep(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(first, kept), "packed")
    open_rows = packed.where("left_over").select("doc_id", "start", "ids", "doc_tokens", "length")
    tasks = -(-(packed.where("left_over").agg(F.sum("length")).first()[0] or 1) // LEFT)
    dealt = open_rows.repartition(tasks, F.xxhash64("doc_id", "start")).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids")
    wanted = names if ids else names[:7]
    return packed.where("NOT left_over").select(wanted).unionByName(dealt.mapInArrow(second, kept).select(wanted))
