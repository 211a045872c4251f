"""FASTA and block-gzip files."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..cluster import ship
from ..functions.alleles import mask_of
from .text import with_line_number


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, start, seq): one row for each line of bases; start counts from 0 within its record.

    Long sequences stay cut into lines. Records are numbered by sums over the lines of all files.
    """
    lines = with_line_number(spark.read.text(path)).withColumn("head", F.col("value").startswith(">"))
    block = F.floor(F.col("line") / 100_000)
    lines = lines.withColumn("block", block)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = lines.groupBy("block").agg(F.sum(F.col("head").cast("long")).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("block").orderBy("line")
    at = lines.join(heads, "block").withColumn("record", F.col("base") + F.sum(F.col("head").cast("long")).over(own))
    names = at.where("head").select("record", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"))
    body = at.where("NOT head AND value <> ''").withColumn("n", F.length(F.trim("value")))
    sums = body.groupBy("record", "block").agg(F.sum("n").alias("s")).withColumn("shift", F.coalesce(F.sum("s").over(Window.partitionBy("record").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("record", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return body.join(sums, ["record", "block"]).withColumn("start", F.col("shift") + within).join(names, "record", "left").select("record", "name", "start", F.trim("value").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, seq): whole sequences, each of which must fit in a row."""
    rows = read_fasta_lines(spark, path).groupBy("record", "name").agg(F.sort_array(F.collect_list(F.struct("start", "seq"))).alias("s"))
    return rows.select("record", "name", F.array_join(F.transform("s", lambda x: x["seq"]), "").alias("seq"))


def bases_at(lines: DataFrame, positions: DataFrame, width: int | None = None) -> DataFrame:
    """(record, pos, base, mask) for positions (record, pos from 1); lines are as read_fasta_lines gives them.

    With a fixed line width the line is computed and joined by equality; otherwise by range within the record.
    """
    if width:
        at = positions.withColumn("start", F.floor((F.col("pos") - 1) / width) * width)
        found = at.join(lines, ["record", "start"])
    else:
        p, s = positions.alias("p"), lines.alias("s")
        found = p.join(s, (F.col("p.record") == F.col("s.record")) & (F.col("s.start") < F.col("p.pos")) & (F.col("p.pos") <= F.col("s.start") + F.length("s.seq"))).select("p.record", "p.pos", "s.start", "s.seq")
    base = F.substring(F.col("seq"), (F.col("pos") - F.col("start")).cast("int"), F.lit(1))
    return found.where(base != "").select("record", "pos", base.alias("base"), mask_of(base).alias("mask"))


#: Bytes of files for each task that lines are dealt to: about a stretch of 100,000 lines of 60 bases.
DEALT = 6_100_000


def _tasks(spark: SparkSession, path: str) -> int:
    """Tasks for the lines of files by their bytes; figures of lines shrink so much that adaptive execution puts millions of rows together."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return 1 + sum(fs.getContentSummary(x.getPath()).getLength() for x in fs.globStatus(hadoop) or []) // DEALT


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, name, offset, width, length): where the bases of each record lie, how many a line has and how many there are.

    Offsets are sums over the lines before, by file and stretch of lines, so no task sums up a file. Files are not
    compressed, and their lines end with one line feed. An error where a line before the last has another width.
    """
    lines = with_line_number(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")))
    lines = lines.withColumns({"block": F.floor(F.col("line") / 100_000), "head": F.col("value").startswith(">"), "bytes": (F.octet_length("value") + 1).cast("bigint")})
    # lines give way to the figures that the index needs, before they are dealt by stretch
    name, n = F.when(F.col("head"), F.regexp_extract("value", r"^>\s*(\S*)", 1)), F.when(~F.col("head"), F.length("value"))
    lines = lines.select("path", "line", "block", "head", "bytes", name.alias("name"), n.alias("n"))
    sums = lines.groupBy("path", "block").agg(F.sum("bytes").alias("s"), F.sum(F.col("head").cast("bigint")).alias("h"))
    of_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    sums = sums.select("path", "block", F.coalesce(F.sum("s").over(of_file), F.lit(0)).alias("from_byte"), F.coalesce(F.sum("h").over(of_all), F.lit(0)).alias("from_head"))
    own = Window.partitionBy("path", "block").orderBy("line")
    dealt = lines.repartition(_tasks(spark, path), "path", "block")
    at = dealt.join(sums, ["path", "block"]).withColumns({"byte": F.col("from_byte") + F.sum("bytes").over(own) - F.col("bytes"), "record": F.col("from_head") + F.sum(F.col("head").cast("bigint")).over(own)})
    n = F.col("n")
    some = F.when(n > 0, F.struct("line", "n"))
    first = at.groupBy("path", "record").agg(
        F.max("name").alias("name"),
        F.min(F.when(n > 0, F.col("byte"))).alias("offset"),
        F.coalesce(F.sum(n), F.lit(0)).alias("length"),
        F.max(n).alias("width"),
        F.max(some)["n"].alias("last"),
        F.count(F.when(n > 0, 1)).alias("lines"),
    )
    fits = F.assert_true((F.col("lines") == 0) | (F.col("length") == (F.col("lines") - 1) * F.col("width") + F.col("last")), F.concat(F.lit("lines of one width are needed: "), "path"))
    return first.withColumn("width", F.when(fits.isNull(), F.col("width"))).select("path", "record", "name", "offset", "width", "length")


def bases_by_index(index: DataFrame, positions: DataFrame) -> DataFrame:
    """(record, pos, base, mask) for positions (record, pos from 1), each read from its own byte; index is as fasta_index gives it.

    Positions beyond a record have no row. Files are on a disk that all executors see. Positions are sorted by file and byte, so a task
    goes through its files once, forwards.
    """
    p = F.col("pos") - 1
    place = F.col("offset") + F.floor(p / F.col("width")) * (F.col("width") + 1) + F.pmod(p, F.col("width"))
    own = positions.select("record", "pos").join(index, "record").where((F.col("pos") >= 1) & (F.col("pos") <= F.col("length")))
    own = own.select(F.expr("parse_url(path, 'PATH')").alias("path"), place.cast("bigint").alias("byte"), "record", "pos")
    own = own.repartitionByRange("path", "byte").sortWithinPartitions("path", "byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, start, held = None, None, 0, b""
        try:
            for batch in batches:
                out = []
                for path, byte in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if path != name:
                        if f:
                            f.close()
                        name, f, held = path, open(path, "rb"), b""
                    if not start <= byte < start + len(held):
                        f.seek(byte)
                        start, held = byte, f.read(4096)
                    out.append(chr(held[byte - start]))
                yield pa.record_batch([batch.column(2), batch.column(3), pa.array(out)], ["record", "pos", "base"])
        finally:
            if f:
                f.close()

    ship(positions.sparkSession)
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"record {kinds['record']}, pos {kinds['pos']}, base string").withColumn("mask", mask_of("base"))


def bgzf_blocks(data: bytes | memoryview) -> Iterator[tuple[int, int]]:
    """(offset, size) of each block of a block-gzip file, from the size that every block's head holds."""
    at = 0
    while at < len(data):
        if bytes(data[at : at + 4]) != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at}")
        extra, field, size = struct.unpack_from("<H", data, at + 10)[0], at + 12, None
        while field < at + 12 + extra:
            tag, length = bytes(data[field : field + 2]), struct.unpack_from("<H", data, field + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + length
        if size is None:
            raise ValueError(f"the block at {at} doesn't hold its size")
        yield at, size
        at += size


#: Compressed bytes of a block at most, by its format, and those of a task.
LARGEST, PART = 1 << 16, 1 << 25


def _size_at(data: bytes, at: int) -> int | None:
    """Size of the block whose head lies at a place, None where there is no head."""
    try:
        return next(bgzf_blocks(memoryview(data)[at:]))[1]
    except (ValueError, StopIteration, struct.error):
        return None


def next_block(f, at: int, end: int) -> int:
    """Offset of the first block from a place on, or the end of the file: the first head whose block can be unpacked."""
    while at < end:
        f.seek(at)
        data = f.read(3 * LARGEST)
        found = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= found < LARGEST:
            size = _size_at(data, found)
            if size is not None and found + size <= len(data):
                try:
                    zlib.decompress(data[found : found + size], 31)
                    return at + found
                except zlib.error:
                    pass
            found = data.find(b"\x1f\x8b\x08\x04", found + 1)
        at += LARGEST
    return end


def _blocks_from(f, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, text) of blocks from a head on."""
    while at < end:
        f.seek(at)
        data = f.read(LARGEST)
        size = _size_at(data, 0)
        if size is None or size > len(data):
            raise ValueError(f"no block at {at}")
        yield at, size, zlib.decompress(data[:size], 31)
        at += size


class _Part(InputPartition):
    def __init__(self, path: str, part: int, first: int, last: int, size: int):
        self.path, self.part, self.first, self.last, self.size = path, part, first, last, size


class BgzfSource(DataSource):
    """spark.read.format("bgzf") with options files (path and size, a JSON list), what (lines or blocks) and part (compressed bytes of a task).

    A task starts at the first block from its first byte on, which it finds by itself, and takes the blocks whose heads lie
    in its bytes. A line belongs to the task in whose blocks it starts, the first of the next task's blocks included; that
    task reads on into the next blocks until the line ends, and others skip what they have of it.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "path string, part int, at bigint, " + ("value string" if self.options.get("what", "lines") == "lines" else "offset bigint, size bigint, data binary")

    def reader(self, schema):
        return _BgzfReader(self.options)


class _BgzfReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.lines, self.step = json.loads(options["files"]), options.get("what", "lines") == "lines", int(options.get("part", PART))

    def partitions(self):
        return [_Part(path, i, a, min(a + self.step, size), size) for path, size in self.files for i, a in enumerate(range(0, size, self.step))]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions
            return
        with open(partition.path, "rb") as f:
            own = _blocks_from(f, next_block(f, partition.first, partition.size), partition.size)
            yield from (self._lines if self.lines else self._whole)(partition, own)

    def _batch(self, p: _Part, first: int, columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(columns[0])
        names = ["value"] if self.lines else ["offset", "size", "data"]
        return pa.record_batch([pa.array([p.path] * n), pa.array([p.part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *columns], ["path", "part", "at", *names])

    def _whole(self, p: _Part, blocks) -> Iterator[pa.RecordBatch]:
        for n, (at, size, text) in enumerate(blocks):
            if at >= p.last:
                return
            yield self._batch(p, n, [pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([text], pa.binary())])

    def _lines(self, p: _Part, blocks) -> Iterator[pa.RecordBatch]:
        n, rest, skip = 0, [], p.first > 0
        for at, _, text in blocks:
            beyond = at >= p.last
            if skip:  # the end of a line that another task has
                if beyond:
                    return
                if b"\n" not in text:
                    continue
                text, skip = text[text.index(b"\n") + 1 :], False
            *whole, left = text.split(b"\n")
            if whole:
                whole[0] = b"".join(rest) + whole[0]
                rest = []
                if beyond:
                    whole = whole[:1]  # what follows starts in the next task's blocks
                yield self._batch(p, n, [pa.array([x.decode() for x in whole])])
                n += len(whole)
                if beyond:
                    return
            rest.append(left)
        if not skip and any(rest):
            yield self._batch(p, n, [pa.array([b"".join(rest).decode()])])


def _bgzf(spark: SparkSession, path: str, what: str, number: str, part: int) -> DataFrame:
    ship(spark)
    spark.dataSource.register(BgzfSource)
    files = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    for status in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []:
        uri = status.getPath().toUri()
        if uri.getScheme() not in (None, "file"):
            raise ValueError(f"{uri} is not on a disk that executors see")
        files.append((uri.getPath(), status.getLen()))
    if not files:
        raise ValueError(f"no file is named {path}")
    rows = spark.read.format("bgzf").options(files=json.dumps(sorted(files)), what=what, part=str(part)).load()
    counts = rows.groupBy("path", "part").agg(F.count("*").alias("n"))  # a row for each part
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["path", "part"]).withColumn(number, F.col("base") + F.col("at")).drop("part", "at", "base")


def read_bgzf(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(path, block, offset, size, data): every block of every file; tasks read parts of files. Files are on a disk that all executors see."""
    return _bgzf(spark, path, "blocks", "block", part).select("path", "block", "offset", "size", "data")


def read_bgzf_lines(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(path, line, value): the lines of block-gzip files, joined where a block ends within a line; tasks read parts of files.

    Lines are numbered from counts of the parts before, so files are read twice where the number is asked for.
    """
    return _bgzf(spark, path, "lines", "line", part).select("path", "line", "value")


#: Bytes of the empty block that ends a file.
EMPTY = 28


def bgzf_compress(data: bytes, block: int = 65280) -> bytes:
    """data as block-gzip, with the empty block that ends a file."""
    out = []
    for i in [*range(0, len(data), block), None]:
        part = b"" if i is None else data[i : i + block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_bgzf_lines(df: DataFrame, path: str, value: str = "value", block: int = 65280) -> None:
    """df's lines as block-gzip files under path, a folder on a disk that all executors see; each partition writes its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, waiting, n = f"{path}/part-{TaskContext.get().partitionId():05d}.bgz", b"", 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for batch in batches:
                waiting += b"".join(x.encode() + b"\n" for x in batch.column(0).to_pylist())
                whole = len(waiting) // block * block
                if whole:
                    f.write(bgzf_compress(waiting[:whole], block)[:-EMPTY])
                    waiting = waiting[whole:]
                n += batch.num_rows
            f.write(bgzf_compress(waiting, block))
        os.replace(f.name, name)  # a task that runs again leaves one file
        yield pa.record_batch([pa.array([n])], ["n"])

    os.makedirs(path, exist_ok=True)
    ship(df.sparkSession)
    df.select(F.coalesce(F.col(value), F.lit(""))).mapInArrow(run, "n long").agg(F.sum("n")).collect()
