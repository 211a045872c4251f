"""Chosen lines of large text files, read by the byte ranges that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship
from .text import with_line_number


def line_index(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """(path, block, line, n, offset, size): where each stretch of at most `rows` lines lies; a table to be written once and kept.

    Lines are numbered over all files, as by with_line_number; block is the number of a stretch's lines by `rows`, and a
    stretch ends with its file. Files aren't compressed, and a line feed ends each line; no lines give no rows.
    Offsets are sums over the stretches before, of which Spark holds a row each: rows should grow with shorter lines.
    """
    lines = with_line_number(spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path")))
    packed = F.col("path").rlike(r"(?i)\.(gz|bgz|bz2|zst|lz4|snappy|deflate)$")
    usable = F.when(packed, F.raise_error(F.concat(F.lit("compressed files have no ranges of lines: "), "path")).cast("bigint")).otherwise(F.octet_length("value") + 1)
    at = lines.select("path", "line", F.floor(F.col("line") / rows).alias("block"), usable.cast("bigint").alias("bytes"))
    sums = at.groupBy("path", "block").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.sum("bytes").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("rows", F.lit(rows)).select("path", "block", "line", "n", "offset", "size", "rows")


def ranges_of(index: DataFrame, keep: DataFrame) -> DataFrame:
    """(path, offset, size, line, wanted): the stretches that hold keep's lines, each with the places of those lines in it, from 0.

    A line that keep names twice is wanted once; NULL and numbers without a line have no range. An index has one value
    of rows, which its own table tells.
    """
    rows = index.agg(F.max("rows")).first()[0] or 1
    asked = keep.select(F.col("line").alias("asked")).where("asked >= 0").withColumn("block", F.floor(F.col("asked") / rows))
    found = asked.join(index.drop("rows"), "block").where("line <= asked AND asked < line + n")
    return found.groupBy("path", "offset", "size", "line").agg(F.array_sort(F.collect_set((F.col("asked") - F.col("line")).cast("int"))).alias("wanted"))


def read_line_ranges(index: DataFrame, keep: DataFrame) -> DataFrame:
    """(line, value): the lines that keep (line) names, of which a task reads the ranges alone; index is as line_index gives it.

    Ranges are dealt by file and place, so a task goes forwards through its files. They are opened by Arrow's file
    systems, so by a path on a shared disk or in an object store. A task holds one stretch of lines.
    """
    spark = index.sparkSession
    own = ranges_of(index, keep).repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != name:
                        if f:
                            f.close()
                        system, at = fs.FileSystem.from_uri(r["path"])
                        name, f = r["path"], system.open_input_file(at)
                    f.seek(r["offset"])
                    lines = f.read(r["size"]).split(b"\n")
                    yield pa.record_batch([pa.array([r["line"] + i for i in r["wanted"]], pa.int64()), pa.array([lines[i].decode() for i in r["wanted"]])], ["line", "value"])
        finally:
            if f:
                f.close()

    ship(spark)
    return own.mapInArrow(run, "line bigint, value string")
