"""Hulls, clusters, unions and disjoint cuts of regions.

Rows whose chromosome is NULL are a group of their own. Regions with a NULL bound come first in their group.

Clusters are found in two steps. Regions are sorted within segments of a chromosome that hold about as many rows each,
and a segment starts with the furthest end of all segments before it, which comes from a table with one row for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segments import Segments, segments


def hull(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """The smallest region that holds all; an error if a group has several chromosomes."""
    one = F.assert_true(F.min(chrom) == F.max(chrom), "regions of several chromosomes have no hull")
    return df.groupBy(*(by or [])).agg(F.when(one.isNull(), F.min(chrom)).alias(chrom), F.min(start).alias(start), F.max(end).alias(end))


def _with(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with the one row of sums that has equal keys; NULL equals NULL."""
    right = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in sums.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(right, same).drop(*[f"__k{i}" for i in range(len(keys))])


def hull_over(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """df with hull_start and hull_end of its chromosome; sums per chromosome are joined back."""
    return _with(df, df.groupBy(chrom).agg(F.min(start).alias("hull_start"), F.max(end).alias("hull_end")), [chrom])


def running(df: DataFrame, chrom: str, start: str, end: str, ties: list[str], what: Column, name: str, cut: Segments, before: str) -> DataFrame:
    """df with the aggregate `what` (max or sum) of all rows before, in the order of start, end and ties."""
    df = cut.number(df, chrom, start)
    totals = df.groupBy(chrom, "__seg").agg(what.alias("__all"))
    fold = F.max if before == "max" else F.sum
    across = Window.partitionBy(chrom).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(chrom, "__seg", fold("__all").over(across).alias("__carry"))
    own = Window.partitionBy(chrom, "__seg").orderBy(start, end, *ties).rowsBetween(Window.unboundedPreceding, -1 if before == "max" else 0)
    df = _with(df, F.broadcast(totals), [chrom, "__seg"])  # a row for each segment
    inner = what.over(own)
    value = F.greatest(inner, F.col("__carry")) if before == "max" else F.coalesce(inner, F.lit(0)) + F.coalesce("__carry", F.lit(0))
    return df.withColumn(name, value).drop("__seg", "__carry")


def clusters(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", ties: list[str] | None = None, compat: bool = False, out: str = "cluster", rows: int | None = None) -> DataFrame:
    """df with the number, from 1 on each chromosome, of its group of overlapping regions; touching regions stay apart.

    compat compares a region with the one before it only, so a region nested in an earlier one can end a group.
    """
    ties, cut = ties or [], segments(df, chrom, start, rows)
    if compat:
        last = F.lag(end).over(Window.partitionBy(chrom).orderBy(start, end, *ties))
        marked = df.withColumn("__new", F.when(F.col(start) < last, 0).otherwise(1))
    else:
        seen = running(df, chrom, start, end, ties, F.max(end), "__end", cut, "max")
        marked = seen.withColumn("__new", F.when(F.col(start) < F.col("__end"), 0).otherwise(1)).drop("__end")
    return running(marked, chrom, start, end, ties, F.sum("__new"), out, cut, "sum").drop("__new")


def cluster_hulls(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", **how) -> DataFrame:
    """df with its cluster and the cluster's hull."""
    at = clusters(df, chrom, start, end, **how)
    hulls = at.groupBy(chrom, "cluster").agg(F.min(start).alias("hull_start"), F.max(end).alias("hull_end"))
    return _with(at, hulls, [chrom, "cluster"])


def merged(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", **how) -> DataFrame:
    """One region for each cluster, and how many it was made from."""
    at = clusters(df, chrom, start, end, **how)
    return at.groupBy(chrom, "cluster").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("cluster")


def union_disjoint(a: DataFrame, b: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", strict: bool = False) -> DataFrame:
    """The regions of both; strict: an error where any two overlap."""
    both = a.select(chrom, start, end).unionByName(b.select(chrom, start, end))
    if not strict:
        return both
    seen = running(both, chrom, start, end, [], F.max(end), "__end", segments(both, chrom, start), "max")
    bad = F.col(start) < F.col("__end")
    return seen.where(F.when(bad, F.raise_error(F.lit("regions overlap")).cast("boolean")).otherwise(True)).drop("__end")


def disjoin(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", rows: int | None = None) -> DataFrame:
    """Maximal regions between neighbouring bounds that at least one region covers, and how many do (depth)."""
    steps = df.select(chrom, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(chrom, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d")).withColumn("__at_end", F.col("at"))
    cut = segments(df, chrom, start, rows)
    deep = cut.number(running(steps, chrom, "at", "__at_end", [], F.sum("d"), "depth", cut, "sum"), chrom, "at")
    firsts = deep.groupBy(chrom, "__seg").agg(F.min("at").alias("__first"))
    firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(chrom).orderBy("__seg"))).drop("__first")
    after = F.lead("at").over(Window.partitionBy(chrom, "__seg").orderBy("at"))
    apart = _with(deep.withColumn("__lead", after), firsts, [chrom, "__seg"]).withColumn("__to", F.coalesce("__lead", "__next"))
    return apart.where("depth > 0").select(chrom, F.col("at").alias(start), F.col("__to").alias(end), "depth")


def ranked(df: DataFrame, by: list[str], out: str = "rank", chrom: str = "chrom", pos: str = "pos", rows: int | None = None) -> DataFrame:
    """df with each row's place, from 1, in the order of by, whose first two columns are chrom and pos.

    Rows are numbered within segments of a chromosome, and each starts where those before it end: no task orders all
    rows or a chromosome. NULLs come first.
    """
    df = segments(df, chrom, pos, rows).number(df, chrom, pos)
    before = Window.orderBy(chrom, "__seg").rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment
    starts = df.groupBy(chrom, "__seg").agg(F.count("*").alias("n")).select(chrom, "__seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(chrom, "__seg").orderBy(*by))
    return _with(df.withColumn("__r", own), starts, [chrom, "__seg"]).withColumn(out, F.col("__r") + F.col("__base")).drop("__seg", "__r", "__base")


def extended_ends(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", least: int = 1, most: int = (1 << 29) - 1) -> DataFrame:
    """df with the first region of each chromosome from `least` on and the last one up to `most`, so that blocks cover all of it."""
    at = hull_over(df, chrom, start, end)
    first, last = F.col(start) == F.col("hull_start"), F.col(end) == F.col("hull_end")
    return at.withColumns({start: F.when(first, F.lit(least).cast("bigint")).otherwise(F.col(start)), end: F.when(last, F.lit(most).cast("bigint")).otherwise(F.col(end))}).drop("hull_start", "hull_end")
