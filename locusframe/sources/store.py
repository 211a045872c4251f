"""A Parquet store of variants, partitioned by chromosome and sorted by position, in place of indexed binary tables.

Reads of regions prune chromosomes by partition and row groups by their smallest and largest position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.allele_join import by_id, by_id_complete
from ..operators.intervals import binned_pair, overlapping, used_levels
from ..operators.islands import merged


def write_store(df: DataFrame, path: str, files_per_chrom: int = 8, mode: str = "error") -> None:
    at = df.repartitionByRange(24 * files_per_chrom, "chrom", "pos").sortWithinPartitions("chrom", "pos")
    at.write.mode(mode).partitionBy("chrom").parquet(path)
    _write_manifest(df.sparkSession, path)


def _manifest_of(path: str) -> str:
    """Beside the data, under a name that Spark's listing of a folder leaves out."""
    return f"{path.rstrip('/')}/_manifest"


def _write_manifest(spark: SparkSession, path: str) -> None:
    """One row for each file of a store: its path, chromosome and first and last position, and how many rows it has."""
    rows = spark.read.parquet(path)
    bounds = rows.groupBy(F.col("_metadata.file_path").alias("file"), "chrom").agg(F.min("pos").cast("bigint").alias("first"), F.max("pos").cast("bigint").alias("last"), F.count("*").alias("rows"))
    bounds.write.mode("overwrite").parquet(_manifest_of(path))


def files_of_regions(spark: SparkSession, path: str, regions: DataFrame) -> list[str]:
    """Paths of the store's files that hold a row's place in any of regions (chrom, start, end); names come to the driver, no rows."""
    files = spark.read.parquet(_manifest_of(path)).where("first IS NOT NULL").withColumn("end", F.col("last") + 1)
    hits = overlapping(files, "file", ("chrom", "first", "end"), regions, ("chrom", "start", "end"))
    return sorted(r["file"] for r in hits.select("file").distinct().collect())


def read_region(spark: SparkSession, path: str, chrom: int, start: int, end: int) -> DataFrame:
    """Rows of one half-open region; both conditions reach the scan."""
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end))


def read_regions(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Rows in any of regions (chrom, start, end), each once.

    Regions are merged first, so that a position lies in one at most, and rows themselves meet them: nothing relies on
    two scans of the store giving rows the same numbers. Only files that overlap a region, by the manifest, are opened.
    """
    apart = merged(regions.where("start < end AND chrom IS NOT NULL")).select(F.col("chrom").alias("__chrom"), F.col("start").alias("__ts"), F.col("end").alias("__te"))
    files = files_of_regions(spark, path, apart.select(F.col("__chrom").alias("chrom"), F.col("__ts").alias("start"), F.col("__te").alias("end")))
    whole = spark.read.parquet(path)
    whole = spark.read.option("basePath", path).schema(whole.schema).parquet(*files) if files else whole.limit(0)
    rows = whole.withColumns({"__qs": F.col("pos").cast("bigint"), "__qe": F.col("pos").cast("bigint") + 1})
    q, t = binned_pair(rows, apart, [0], used_levels(apart, "__ts", "__te"))
    found = q.join(t, (q["chrom"] == t["__chrom"]) & (q["__code"] == t["__code"]) & (q["__bin"] == t["__bin"]) & (F.col("__ts") <= F.col("__qs")) & (F.col("__qs") < F.col("__te")))
    return found.select(*[q[c] for c in rows.columns if not c.startswith("__")])


def read_rsids(spark: SparkSession, path: str, rsids: DataFrame, allow_missing: bool = True) -> DataFrame:
    """Rows of the given rsids; without allow_missing an error if one isn't found."""
    rows = spark.read.parquet(path)
    return by_id(rows, rsids, "rsid") if allow_missing else by_id_complete(rows, rsids, "rsid")


def each_region(regions: DataFrame, read, *steps, write=None) -> DataFrame | None:
    """read(regions), then the steps in order, each DataFrame to DataFrame, then write."""
    df = read(regions)
    for step in steps:
        df = df.transform(step)
    return write(df) if write else df
