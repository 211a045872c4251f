"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record is
    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    payload   flags (1 byte: 1 null key, 2 ids of 4 bytes), key (8 bytes), ids (2 or 4 bytes each)
    4 bytes   masked CRC-32 of the payload
    1 byte    a line feed
The mask is the usual rotation by 15 bits plus a constant, so that a checksum stored inside checked data does
no harm. The line feed at the end lets Spark's own text writer write the files, to any file system it knows
and with its protocol for failed and repeated tasks; executors never open files themselves.

Null and empty texts have the end id alone. Rows come in ascending order of key, null keys first, rows of one
key by a hash of their text; that hash also splits a key that holds many rows over several files. Empty
tables write no records.

Spark hands over a file as one value, several times over in the JVM's memory. So a task writes several files of FILE
bytes at most, unless one record is longer; their order is that of their tasks (part) and, within a task, of their
numbers (file).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace
from .token_ids import encoder

END = 1
#: Fixed value of the record format.
MASK_DELTA = 0xA282EAD8
#: Bytes of a file, unless one record is longer.
FILE = 1 << 20
_HEAD, _KEY = struct.Struct("<QI"), struct.Struct("<Bq")
INDEX = "part int, file int, ordinal long, key long, offset long, length long, before long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes) -> bytes:
    """One record without its line feed; ids are little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    flags = (key is None) | (2 if wide.size and wide.max() > 0xFFFF else 0)
    payload = _KEY.pack(flags, key or 0) + (ids if flags & 2 else wide.astype("<u2").tobytes())
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def parse(data: memoryview | bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(key, ids, offset of the next record) of the record at an offset; raises ValueError where a checksum fails."""
    head = bytes(data[at : at + 12])
    size, crc = _HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError(f"damaged length at {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or struct.pack("<I", masked(payload)) != bytes(data[at + 12 + size : at + 16 + size]):
        raise ValueError(f"damaged record at {at}")
    flags, key = _KEY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_KEY.size)
    return None if flags & 1 else key, ids, at + 17 + size


def write_records(docs: DataFrame, key: str, text: str, tokenizer: str, path: str) -> None:
    """Writes docs' records under path, files in the order of key; as many tasks write as docs has partitions."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, size = encoder(tokenizer), [], 0

        def file() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"\n".join(out)], pa.binary())], ["value"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, ids in e.rows(batch.column(1), END):
                record = frame(keys[i], ids)
                if out and size + len(record) + 1 > FILE:
                    yield file()
                    out, size = [], 0
                out.append(record)
                size += len(record) + 1
        if out:
            yield file()
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it holds

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), F.col("key").asc_nulls_first(), tie)
    rows = rows.sortWithinPartitions(F.col("key").asc_nulls_first(), tie)
    rows.mapInArrow(frames, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def index_records(ws: Workspace, path: str) -> DataFrame:
    """The index of the files under path, from reading and checking every record; written to ws."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # what a worker that wrote records remembers is of no use here
        for batch in batches:
            for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data, at, before, out = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    key, ids, after = parse(data, at)
                    out.append((part, file, len(out), key, at, after - at, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before, at = before + len(ids), after
                columns = list(zip(*out, strict=True)) or [()] * 9
                yield pa.record_batch([*[pa.array(c, pa.int32()) for c in columns[:2]], *[pa.array(c, pa.int64()) for c in columns[2:]]], [c.split()[0] for c in INDEX.split(", ")])

    files = ws.spark.read.format("binaryFile").load(path)
    number = lambda pattern, name: F.regexp_extract("path", pattern, 1).cast("int").alias(name)
    return ws.keep(files.select(number(r"part-(\d+)[^/]*$", "part"), number(r"-c(\d+)[^/]*$", "file"), "content").mapInArrow(entries, INDEX), "index")


def with_starts(index: DataFrame) -> DataFrame:
    """index with start: the number of ids in all records before.

    Sums go over the tasks that wrote, one row each, and then over the files of each task.
    """
    earlier = (Window.unboundedPreceding, -1)
    total = lambda over: F.coalesce(F.sum("n").over(over), F.lit(0))
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", total(Window.orderBy("part").rowsBetween(*earlier)).alias("of_part"))
    within = files.select("part", "file", total(Window.partitionBy("part").orderBy("file").rowsBetween(*earlier)).alias("of_file"))
    rows = index.join(within, ["part", "file"]).join(parts, "part")
    return rows.withColumn("start", F.col("of_part") + F.col("of_file") + F.col("before")).drop("of_part", "of_file")
