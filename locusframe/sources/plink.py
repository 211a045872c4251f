"""Binary genotype files: a three-byte head, then ceil(n / 4) bytes for each variant.

The reader is a Spark data source whose partitions are ranges of variants; a task seeks to its range and reads
no more. The file must be on a disk that all executors see.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..cluster import ship
from ..functions.genotypes import pack_dosages, unpack_dosages
from ..operators.islands import ranked
from .text import read_bim, read_fam, with_line_number, write_bim, write_fam

#: Fixed value of the format.
HEAD = bytes([0x6C, 0x1B, 0x01])


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlinkSource(DataSource):
    """spark.read.format("plink_bed") with options path, n (samples), variants; optional ranges and part (variants of a task).

    ranges is a JSON list of [first, last) of variants to read, and all others are passed over. They are an option and no pushed
    conditions, as Spark 4.1 lets all scans of one loaded DataFrame read what the last of them pushed. Saving a DataFrame
    (variant_index from 0 without gaps, data) in this format writes the file. path is a local or mounted file that every executor sees.
    """

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "variant_index bigint, data binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n, self.p = options["path"], int(options["n"]), int(options["variants"])
        self.ranges, self.part = json.loads(options.get("ranges", f"[[0, {self.p}]]")), int(options.get("part", 100_000))

    def partitions(self):
        return [_Range(a, min(a + self.part, last)) for first, last in self.ranges for a in range(max(0, first), min(self.p, last), self.part)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        width = (self.n + 3) // 4
        if partition is None:  # what Spark makes of no partitions
            return
        with open(self.path, "rb") as f:
            if f.read(3) != HEAD:
                raise ValueError(f"{self.path} is not in variant-major binary genotype format")
            f.seek(3 + partition.first * width)
            at = partition.first
            while at < partition.last:
                k = min(4096, partition.last - at)
                data = f.read(k * width)
                if len(data) != k * width:
                    raise ValueError(f"{self.path} ends before variant {at + k}")
                yield pa.record_batch([pa.array(range(at, at + k), pa.int64()), pa.array([data[i * width : (i + 1) * width] for i in range(k)], pa.binary())], ["variant_index", "data"])
                at += k


class _Written(WriterCommitMessage):
    def __init__(self, rows: int, indices: int, last: int, width: int | None):
        self.rows, self.indices, self.last, self.width = rows, indices, last, width


class _Writer(DataSourceWriter):
    """Tasks write rows to their places in a file of another name, which takes its own on commit and goes on abort.

    A task that runs again writes the same bytes to the same places, so attempts need no names of their own.
    """

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.at = options["path"], f"{options['path']}.{uuid.uuid4().hex}"
        names = schema.names
        if set(names) != {"variant_index", "data"}:
            raise ValueError("columns variant_index and data are written")
        self.index, self.data = names.index("variant_index"), names.index("data")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} is there already; mode overwrite takes its place")
        with open(self.at, "wb") as f:
            f.write(HEAD)

    def write(self, rows) -> WriterCommitMessage:
        n, total, last, width, place = 0, 0, -1, None, None
        with open(self.at, "r+b") as f:
            for row in rows:
                i, data = row[self.index], row[self.data]
                width = len(data) if width is None else width
                if len(data) != width:
                    raise ValueError("variants differ in their number of samples")
                to = 3 + i * width
                if to != place:
                    f.seek(to)
                f.write(data)
                place, n, total, last = to + width, n + 1, total + i, max(last, i)
        return _Written(n, total, last, width)

    def commit(self, messages) -> None:
        told = [m for m in messages if m is not None]
        n, last = sum(m.rows for m in told), max((m.last for m in told), default=-1)
        if len({m.width for m in told} - {None}) > 1:
            self.abort(messages)
            raise ValueError("variants differ in their number of samples")
        if n != last + 1 or sum(m.indices for m in told) != n * (n - 1) // 2:
            self.abort(messages)
            raise ValueError("variant_index must count from 0 without gaps")
        os.replace(self.at, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.at):
            os.remove(self.at)


def _source(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PlinkSource)


def read_bed_genotypes(spark: SparkSession, path: str, n: int, variants: int, indices: DataFrame | None = None, part: int = 100_000, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """(variant_index from 0, n, data, dosages). ranges: [first, last) of the variants to read, which come once if ranges overlap; indices: a table of those to keep."""
    _source(spark)
    options = {"path": path, "n": str(n), "variants": str(variants), "part": str(part)}
    if ranges is not None:
        apart: list[list[int]] = []
        for first, last in sorted(r for r in ranges if r[0] < r[1]):
            if apart and first <= apart[-1][1]:
                apart[-1][1] = max(apart[-1][1], last)
            else:
                apart.append([first, last])
        options["ranges"] = json.dumps(apart)
    rows = spark.read.format("plink_bed").options(**options).load()
    if indices is not None:
        rows = _seek(indices, path, n, variants)
    return rows.select("variant_index", F.lit(n).alias("n"), "data", unpack_dosages("data", n).alias("dosages"))


def _seek(indices: DataFrame, path: str, n: int, variants: int) -> DataFrame:
    """(variant_index, data) of the given variants; each task reads its own by their place in the file and nothing between."""
    width = (n + 3) // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            if f.read(3) != HEAD:
                raise ValueError(f"{path} is not in variant-major binary genotype format")
            for batch in batches:
                out = []
                for i in batch.column(0).to_pylist():
                    f.seek(3 + i * width)
                    out.append(f.read(width))
                    if len(out[-1]) != width:
                        raise ValueError(f"{path} ends before variant {i + 1}")
                yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["variant_index", "data"])

    own = indices.select(F.col("variant_index").cast("bigint")).where((F.col("variant_index") >= 0) & (F.col("variant_index") < variants)).distinct()
    return own.repartitionByRange("variant_index").sortWithinPartitions("variant_index").mapInArrow(run, "variant_index bigint, data binary")


def read_plink(spark: SparkSession, prefix: str) -> DataFrame:
    """Variants of prefix.bim with their genotypes from prefix.bed; samples are those of prefix.fam."""
    bim = with_line_number(read_bim(spark, f"{prefix}.bim"), "variant_index")
    n, p = read_fam(spark, f"{prefix}.fam").count(), bim.count()
    return bim.join(read_bed_genotypes(spark, f"{prefix}.bed", n, p), "variant_index")


def write_bed_genotypes(df: DataFrame, path: str, order: str = "variant_index", data: str = "data", append: bool = False) -> None:
    """One file in the order of variants, on a disk that all executors see.

    Every variant takes the same number of bytes, so its rank says where it lies, and tasks write their own ranges at
    once. A write that fails leaves no file. append adds to the file itself. No row comes to the driver.
    """
    spark = df.sparkSession
    _source(spark)
    rows = ranked(df.select(F.lit(0).alias("__c"), F.col(order).alias("__o"), F.col(data).alias("__d")), ["__c", "__o"], "__n", "__c", "__o")
    if append:
        _append(rows.select("__n", "__d"), path)
    else:
        rows.select((F.col("__n") - 1).cast("bigint").alias("variant_index"), F.col("__d").alias("data")).write.format("plink_bed").mode("overwrite").option("path", path).save()


def _append(rows: DataFrame, path: str) -> None:
    """Rows (rank from 1, data) after those that a file has."""
    begin = os.path.getsize(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        with open(path, "r+b") as f:
            for batch in batches:
                for rank, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    width = len(x) if width is None else width
                    if len(x) != width:
                        raise ValueError("variants differ in their number of samples")
                    f.seek(begin + (rank - 1) * width)
                    f.write(x)
        yield pa.record_batch([pa.array([] if width is None else [width], pa.int64())], ["width"])

    if len({r["width"] for r in rows.mapInArrow(run, "width bigint").distinct().collect()}) > 1:  # one row for each width
        raise ValueError("variants differ in their number of samples")


def write_plink(variants: DataFrame, fam: DataFrame, prefix: str, dosages: str = "dosages", parts: int | None = None) -> None:
    """prefix.bed as one file, prefix.bim and prefix.fam as folders of text parts, whose order is that of their names."""
    write_bed_genotypes(variants.withColumn("data", pack_dosages(dosages)), f"{prefix}.bed")
    at = variants.repartitionByRange(parts, "variant_index").sortWithinPartitions("variant_index") if parts else variants.orderBy("variant_index")
    write_bim(at, f"{prefix}.bim", "overwrite")
    write_fam(fam, f"{prefix}.fam", "overwrite")
