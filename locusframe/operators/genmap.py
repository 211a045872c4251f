"""Genetic maps: interpolation of cumulative positions, windows on them, checks and repairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import as_of
from .segments import segments


def steps(knots: DataFrame, chrom: str = "chrom", pos: str = "pos", cm: str = "cm", out: str = "step") -> DataFrame:
    """knots with the distance on the map from the knot before, NULL for the first of a chromosome."""
    return knots.withColumn(out, F.abs(F.col(cm) - F.lag(cm).over(Window.partitionBy(chrom).orderBy(pos))))


def interpolate(q: DataFrame, knots: DataFrame, chrom: str = "chrom", pos: str = "pos", cm: str = "cm", out: str = "map", strict: bool = False) -> DataFrame:
    """q with the map's value at each position: linear between knots of the chromosome, and beyond the ends by their last two.

    Chromosomes with fewer than two knots give the knot's value on the knot itself and NULL elsewhere. Where the last two
    knots of an end share a position, what lies beyond has no line: NaN, or infinite if their values differ. strict
    raises for positions beyond the ends. The end knots are one row for each chromosome.
    """
    value = F.struct(F.col(pos).cast("bigint").alias("p"), F.col(cm).alias("m"))
    at = as_of(q, chrom, pos, knots, chrom, pos, value, "__prev", "__next")
    own = Window.partitionBy(chrom).orderBy(pos)
    rank = knots.select(chrom, value.alias("__v"), F.row_number().over(own).alias("__i"), F.row_number().over(Window.partitionBy(chrom).orderBy(F.col(pos).desc())).alias("__j")).where("__i <= 2 OR __j <= 2")
    pick = lambda c, i: F.max(F.when(F.col(c) == i, F.col("__v")))
    ends = rank.groupBy(F.col(chrom).alias("__ec")).agg(pick("__i", 1).alias("a0"), pick("__i", 2).alias("a1"), pick("__j", 2).alias("z0"), pick("__j", 1).alias("z1"))
    at = at.join(ends, F.col(chrom) == F.col("__ec"), "left")
    p = F.col(pos)

    def line(a: str, b: str) -> Column:
        over, run = p - F.col(f"{a}.p"), F.col(f"{b}.p") - F.col(f"{a}.p")
        return F.col(f"{a}.m") + F.when(run != 0, over / run).otherwise(over * F.lit(math.inf)) * (F.col(f"{b}.m") - F.col(f"{a}.m"))

    value = F.when(F.col("__prev.p") == p, F.col("__prev.m")).when(F.col("__prev").isNotNull() & F.col("__next").isNotNull(), line("__prev", "__next")).when(F.col("__prev").isNull(), line("a0", "a1")).otherwise(line("z0", "z1"))
    if strict:
        beyond = (F.col("__prev").isNull() | F.col("__next").isNull()) & ~F.coalesce(F.col("__prev.p") == p, F.lit(False))
        value = F.when(beyond, F.raise_error(F.lit("position outside the map")).cast("double")).otherwise(value)
    return at.withColumn(out, value).drop("__prev", "__next", "__ec", "a0", "a1", "z0", "z1")


def windows(df: DataFrame, width: float, chrom: str = "chrom", pos: str = "pos", cm: str = "cm", rows: int | None = None) -> DataFrame:
    """df with start and end of the region of all positions whose map value is at most width / 2 away.

    The frame is a range over doubles, which only SQL text can express. A chromosome is cut into segments of about as many
    rows each, and every segment also gets the rows within half a width of it, so no task sorts a chromosome. A row
    without a map value has no region.
    """
    half = width / 2
    cut = segments(df, chrom, cm, rows)
    near = cut.number(df.withColumns({"__low": F.col(cm) - half, "__high": F.col(cm) + half}), chrom, "__low", "__from")
    near = cut.number(cut.number(near, chrom, "__high", "__to"), chrom, cm, "__own")
    over = f"OVER (PARTITION BY `{chrom}`, __seg ORDER BY `{cm}` RANGE BETWEEN CAST({half!r} AS DOUBLE) PRECEDING AND CAST({half!r} AS DOUBLE) FOLLOWING)"
    near = near.withColumn("__seg", F.explode(F.sequence("__from", "__to")))
    seen = near.withColumns({"start": F.expr(f"min(`{pos}`) {over}"), "end": F.expr(f"max(`{pos}`) {over} + 1")}).where("__seg = __own")
    known = F.col(cm).isNotNull()
    return seen.withColumns({"start": F.when(known, F.col("start")), "end": F.when(known, F.col("end"))}).drop("__seg", "__own", "__from", "__to", "__low", "__high")


def not_increasing(knots: DataFrame, chrom: str = "chrom", pos: str = "pos", cm: str = "cm") -> DataFrame:
    """The knots whose value isn't above the one before."""
    last = F.lag(cm).over(Window.partitionBy(chrom).orderBy(pos))
    return knots.withColumn("__last", last).where(F.col("__last") >= F.col(cm)).drop("__last")


def checked(knots: DataFrame, chrom: str = "chrom", pos: str = "pos", cm: str = "cm") -> DataFrame:
    """knots; an error where values don't increase."""
    last = F.lag(cm).over(Window.partitionBy(chrom).orderBy(pos))
    bad = last >= F.col(cm)
    return knots.withColumn("__ok", F.when(bad, F.raise_error(F.lit("the map does not increase")).cast("boolean")).otherwise(True)).where("__ok").drop("__ok")


def jittered(knots: DataFrame, step: float, chrom: str = "chrom", pos: str = "pos", cm: str = "cm") -> DataFrame:
    """knots with step times the rank added to each value, which separates ties."""
    return knots.withColumn(cm, F.col(cm) + F.row_number().over(Window.partitionBy(chrom).orderBy(pos)) * step)


def jittered_until_increasing(knots: DataFrame, step: float, rounds: int = 10, **names) -> DataFrame:
    """jittered with a step that grows tenfold until values increase; each round is one count on the cluster."""
    for i in range(rounds):
        out = jittered(knots, step * 10**i, **names)
        if not_increasing(out, **names).isEmpty():
            return out
    raise ValueError("the map can't be made to increase")


def theta(m: int | Column) -> Column:
    """Mutation rate of m individuals: (1 / s) / (2 m + 1 / s), s the sum of 1 / i for i below 2 m."""
    if isinstance(m, int):  # a constant of the plan, not a sum for each row
        total = sum(1.0 / i for i in range(1, 2 * m))
        return F.lit((1.0 / total) / (2.0 * m + 1.0 / total))
    s = F.aggregate(F.sequence(F.lit(1), (2 * m - 1).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return (1.0 / s) / (2.0 * m + 1.0 / s)


def rho(a: Column, b: Column, m: int, ne: float, cutoff: float) -> Column:
    """Decay between two map values: exp(-4 ne |a - b| / 100 / (2 m)), 0 below cutoff."""
    value = F.exp(-F.abs(a - b) * (4.0 * ne / 100.0 / (2.0 * m)))
    return F.when(value < cutoff, 0.0).otherwise(value)
