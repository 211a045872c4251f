"""Random regions and variants, the same for the same seed and number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def random_regions(spark: SparkSession, n: int, sizes: DataFrame, seed: int, chrom: str = "chrom", size: str = "size") -> DataFrame:
    """(id, chrom, start, end): n regions, chromosomes chosen by size, bounds uniform; sizes has one row for each chromosome."""
    upto = Window.orderBy(chrom)
    cut = sizes.select(chrom, size, F.sum(size).over(upto).alias("hi"), F.sum(size).over(Window.partitionBy()).alias("total")).withColumn("lo", F.col("hi") - F.col(size))
    u = spark.range(n).select("id", F.rand(seed).alias("u"), F.rand(seed + 1).alias("a"), F.rand(seed + 2).alias("b"))
    at = u.join(F.broadcast(cut), (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi")))  # 24 rows
    x, y = (F.floor(F.col(c) * F.col(size)) + 1 for c in "ab")
    return at.select("id", chrom, F.least(x, y).alias("start"), (F.greatest(x, y) + 1).alias("end"))


def random_variants(spark: SparkSession, n: int, sizes: DataFrame, seed: int, chrom: str = "chrom", size: str = "size") -> DataFrame:
    """(id, chrom, pos, ref, alt) with different alleles."""
    at = random_regions(spark, n, sizes, seed, chrom, size).withColumns({"r": F.floor(F.rand(seed + 3) * 4), "d": F.floor(F.rand(seed + 4) * 3) + 1})
    allele = lambda x: F.element_at(F.array(*[F.lit(v) for v in (1, 2, 4, 8)]), (x + 1).cast("int"))
    return at.select("id", chrom, F.col("start").alias("pos"), allele(F.col("r")).alias("ref"), allele((F.col("r") + F.col("d")) % 4).alias("alt"))


def sample_in_regions(regions: DataFrame, rid: str, n: int, seed: int, replace: bool = True, start: str = "start", end: str = "end") -> DataFrame:
    """(rid, draw, pos): n positions of each half-open region; without replacement at most its width.

    Without replacement every set of n positions is as likely as any other (Floyd's method): the k-th draw takes a
    position below width - n + k, or the last of those if it is taken. Randomness is a hash of the region's number, the
    seed and the draw, and no region is expanded.
    """
    width = (F.col(end) - F.col(start)).cast("bigint")
    rows = regions.where(width > 0)
    if replace:
        rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
        return rows.select(rid, "draw", (F.col(start) + F.floor(F.rand(seed) * width)).alias("pos"))
    m = F.least(F.lit(n).cast("bigint"), width)

    def take(taken: Column, upto: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.col(rid), F.lit(seed), upto), 11).cast("double") / float(1 << 53)
        at = F.floor(u * upto).cast("bigint")
        return F.array_append(taken, F.when(F.array_contains(taken, at), upto - 1).otherwise(at))

    drawn = F.aggregate(F.sequence(width - m + 1, width), F.array().cast("array<bigint>"), take)
    rows = rows.select(rid, F.col(start).cast("bigint").alias("__start"), F.posexplode(drawn).alias("__i", "__at"))
    return rows.select(rid, (F.col("__i") + 1).alias("draw"), (F.col("__start") + F.col("__at")).alias("pos"))
