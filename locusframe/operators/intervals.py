"""Interval joins as equi-joins on bins.

A region's own level is the finest one whose bins are as wide as it is, so it touches one or two bins there, and one or
two at each coarser level. A pair meets at the coarser of its two levels: where that is the target's, queries look
there from below, and where it is the query's, targets do. Both cases are one join on (chrom, level and case, bin), which
Spark shuffles, sorts or broadcasts as it sees fit, and an exact condition follows. A pair is taken only in the first
bin that both touch, so it comes once without a distinct. However wide a region is, on either side, it gives a few rows
and not one for each fine bin, and the 24 chromosomes are no skew. A small aggregate over the bounds of each side says
which levels come up, and rows are made for those only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .islands import running
from .segments import segments

#: Bases of a bin at each level; the last level holds all that is wider.
LEVELS = (1 << 8, 1 << 11, 1 << 14, 1 << 17, 1 << 20, 1 << 23, 1 << 30)
Span = tuple[str, str, str]
#: Code of a level in a row's key where the query's level is the coarser one.
_FROM_QUERY = 100


def _level(start: Column, end: Column, levels: Sequence[int]) -> Column:
    level = F.lit(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        level = F.when(end - start <= levels[i], i).otherwise(level)
    return F.when(start < end, level)


def _side(df: DataFrame, key: str, span: Span, names: tuple[str, str, str]) -> DataFrame:
    return df.select(F.col(key).alias(names[0]), F.col(span[0]).alias("__chrom"), F.col(span[1]).cast("bigint").alias(names[1]), F.col(span[2]).cast("bigint").alias(names[2]))


def partitions(df: DataFrame) -> int:
    """Partitions for rows that become many more in their task, which adaptive execution can't tell from their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def used_levels(df: DataFrame, start: str, end: str, levels: Sequence[int] = LEVELS) -> list[int]:
    """The levels that regions of df have, from one aggregate over their bounds."""
    return sorted(df.agg(F.collect_set(_level(F.col(start), F.col(end), levels))).first()[0])


def _bins(df: DataFrame, start: str, end: str, own: str, first: str, looks: dict[int, tuple[str, int]], levels: Sequence[int]) -> DataFrame:
    """df with a row for each bin that it touches at the levels it looks at: looks has, by code, whether its own level must be "at" or "upto" or "below" a level."""
    s, e, level = F.col(start), F.col(end), F.col(own)
    none = F.array().cast("array<struct<code:int,bin:bigint,first:bigint>>")

    def at_level(code: int, rule: str, at: int) -> Column:
        width = F.lit(levels[at]).cast("bigint")
        lo, hi = F.floor(s / width), F.floor((e - 1) / width)
        wanted = {"at": level == at, "upto": level <= at, "below": level < at}[rule]
        made = F.transform(F.sequence(lo, hi), lambda b: F.struct(F.lit(code).alias("code"), b.alias("bin"), lo.alias("first")))
        return F.when(wanted, made).otherwise(none)

    parts = [at_level(code, rule, at) for code, (rule, at) in looks.items()]
    every = F.concat(*parts) if parts else none
    out = df.withColumn(own, _level(s, e, levels)).withColumn("__at", F.explode(every))
    return out.select("*", F.col("__at.code").alias("__code"), F.col("__at.bin").alias("__bin"), F.col("__at.first").alias(first)).drop("__at", own)


def binned_pair(q: DataFrame, t: DataFrame, q_levels: Sequence[int], t_levels: Sequence[int], levels: Sequence[int] = LEVELS, within: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides, (.., __qs, __qe) and (.., __ts, __te), with a row for each bin where they may meet."""
    up = [x for x in t_levels if any(y <= x for y in q_levels)]
    down = [] if within else [x for x in q_levels if any(y < x for y in t_levels)]
    ql = _bins(q, "__qs", "__qe", "__qlevel", "__qfirst", {x: ("upto", x) for x in up} | {x + _FROM_QUERY: ("at", x) for x in down}, levels)
    tl = _bins(t, "__ts", "__te", "__tlevel", "__tfirst", {x: ("at", x) for x in up} | {x + _FROM_QUERY: ("below", x) for x in down}, levels)
    return ql, tl


def overlap_pairs(q: DataFrame, qid: str, q_span: Span, t: DataFrame, tid: str, t_span: Span, within: bool = False, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(qid, tid) of all overlapping half-open regions of one chromosome; within: of queries that lie inside the target.

    Regions with a NULL bound or without a base match nothing.
    """
    ql, tl = _side(q, qid, q_span, ("__q", "__qs", "__qe")).where("__qs < __qe AND __chrom IS NOT NULL"), _side(t, tid, t_span, ("__t", "__ts", "__te")).where("__ts < __te AND __chrom IS NOT NULL")
    ql, tl = binned_pair(ql, tl, used_levels(ql, "__qs", "__qe", levels), used_levels(tl, "__ts", "__te", levels), levels, within)
    fits = (F.col("__ts") <= F.col("__qs")) & (F.col("__qe") <= F.col("__te")) if within else (F.col("__qs") < F.col("__te")) & (F.col("__ts") < F.col("__qe"))
    parts = partitions(q)
    # a number of partitions, as adaptive execution would put bins together by their few bytes and not by their many pairs
    a, b = (x.repartition(parts, "__chrom", "__code", "__bin").alias(name) for x, name in ((ql, "a"), (tl, "b")))
    same = (F.col("a.__chrom") == F.col("b.__chrom")) & (F.col("a.__code") == F.col("b.__code")) & (F.col("a.__bin") == F.col("b.__bin"))
    pairs = a.join(b, same & fits & (F.col("a.__bin") == F.greatest("__qfirst", "__tfirst")))
    return pairs.select(F.col("__q").alias(qid), F.col("__t").alias(tid))


def with_point_span(df: DataFrame, pos: str = "pos", end: str = "pos_end") -> DataFrame:
    """df with the end of a position's one-base region."""
    return df.withColumn(end, F.col(pos) + 1)


def first_match(q: DataFrame, qid: str, q_span: Span, t: DataFrame, tid: str, t_span: Span, within: bool = False, rows: int | None = None) -> DataFrame:
    """(qid, tid): for each query the smallest matching target, NULL without one. Queries are told apart by qid.

    No pairs are made, so targets may overlap each other however often. A target matches if its start is at or before one
    position of the query and its end at or after another. Distinct starts of a chromosome are numbered; the first r of
    them are a few nodes of a binary tree, one for each bit of r, and a target is put into the nodes that hold its start.
    Within a node, whose rows are a window of their own, a running minimum from the furthest end down answers all queries.
    """
    x, y = (F.col("__qs"), F.col("__qe")) if within else (F.col("__qe") - 1, F.col("__qs") + 1)
    asked = _side(q, qid, q_span, ("__q", "__qs", "__qe"))
    fits = F.coalesce((F.col("__qs") < F.col("__qe")) & F.col("__chrom").isNotNull(), F.lit(False))
    asked = asked.select("__chrom", F.when(fits, x).alias("__x"), F.when(fits, y).alias("__y"), "__q", F.lit(2).alias("__kind"))
    marks = _side(t, tid, t_span, ("__t", "__ts", "__te")).where("__ts < __te AND __chrom IS NOT NULL")
    marks = marks.repartition(partitions(t), "__chrom", "__ts")  # a file of many small rows is one task, which would hold all its sums
    starts = marks.groupBy("__chrom", F.col("__ts").alias("__x")).agg(F.lit(0).alias("__kind"))
    marks = marks.groupBy("__chrom", F.col("__ts").alias("__x"), F.col("__te").alias("__y")).agg(F.min("__t").alias("__t"), F.lit(1).alias("__kind"))
    most = starts.groupBy("__chrom").count().agg(F.max("count")).first()[0] or 0
    # starts come before all else at their position, so a row's number is that of distinct starts at or before it
    both = starts.unionByName(marks, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    cut = segments(both, "__chrom", "__x", rows)
    both = running(both.withColumn("__one", (F.col("__kind") == 0).cast("int")), "__chrom", "__x", "__kind", [], F.sum("__one"), "__r", cut, "sum").where("__kind > 0")
    bit = lambda n, level: F.call_function("shiftright", n, level)
    query, at = F.col("__kind") == 2, F.when(F.col("__kind") == 2, F.col("__r")).otherwise(F.col("__r") - 1)
    wanted = F.filter(F.array(*map(F.lit, range(most.bit_length()))).cast("array<int>"), lambda level: (bit(at, level) % 2) == F.when(query & F.col("__x").isNotNull(), 1).when(query, -1).otherwise(0))
    placed = both.select("__chrom", "__y", "__q", "__t", "__kind", at.alias("__at"), F.explode_outer(wanted).alias("__level"))
    # a query that no node answers goes to any task
    node = F.when(F.col("__level").isNull(), F.pmod(F.xxhash64("__q"), F.lit(4096))).when(query, bit(F.col("__at"), F.col("__level")) - 1).otherwise(bit(F.col("__at"), F.col("__level")))
    placed = placed.select("__chrom", "__y", "__q", "__t", "__kind", F.coalesce("__level", F.lit(-1)).alias("__level"), node.alias("__node"))
    keys, found = ["__chrom", "__level", "__node"], F.col("__up")
    coarse = cut.every(8)
    if coarse.bounds:  # the nodes near the root hold many rows, and are dealt by stretches of ends
        placed = coarse.number(placed, "__chrom", "__y")
        down = Window.partitionBy(*keys).orderBy(F.col("__seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = placed.groupBy(*keys, "__seg").agg(F.min("__t").alias("__all")).withColumn("__beyond", F.min("__all").over(down)).drop("__all").where("__beyond IS NOT NULL")
        known = [F.col(k).alias(f"{k}_e") for k in (*keys, "__seg")]
        placed = placed.join(ends.select(*known, "__beyond"), [F.col(k) == F.col(f"{k}_e") for k in (*keys, "__seg")], "left").drop(*[f"{k}_e" for k in (*keys, "__seg")])
        keys, found = [*keys, "__seg"], F.least("__up", "__beyond")
    over = Window.partitionBy(*keys).orderBy(F.col("__y").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("__up", F.min("__t").over(over)).where("__kind = 2").select(F.col("__q").alias(qid), found.alias(tid))
    return seen.groupBy(qid).agg(F.min(tid).alias(tid))


def _reached(q: DataFrame, q_span: Span, t: DataFrame, t_span: Span, out: str, rows: int | None = None) -> DataFrame:
    """q with whether any target overlaps the row: of those that start before its end the furthest end is beyond its start."""
    start, end = (F.col(c).cast("bigint") for c in t_span[1:])
    asked = q.withColumn("__before", F.col(q_span[2]).cast("bigint") - 1)
    seen = as_of(asked, q_span[0], "__before", t.where(start < end), t_span[0], t_span[1], F.struct(start.alias("start")), "__prev", "__next", rows, F.struct(end.alias("end")))
    hit = (F.col(q_span[1]) < F.col(q_span[2])) & (F.col("__prev.end") > F.col(q_span[1]))
    return seen.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__before", "__prev", "__next")


def flagged(q: DataFrame, qid: str, q_span: Span, t: DataFrame, t_span: Span, out: str = "overlaps", rows: int | None = None) -> DataFrame:
    """(qid, out): whether any target overlaps the query; regions or positions (as one-base regions) on either side."""
    return _reached(q.select(qid, *q_span), q_span, t, t_span, "__hit", rows).select(qid, F.col("__hit").alias(out))


def block_of(q: DataFrame, qid: str, q_span: Span, blocks: DataFrame, block: str, b_span: Span) -> DataFrame:
    """(qid, block's columns): the first block, by its number, that holds or overlaps each query; NULLs without one."""
    made = F.struct(block, *[c for c in blocks.columns if c != block])
    found = first_match(q, qid, q_span, blocks.withColumn("__block", made), "__block", b_span)
    return found.select(qid, *[F.col(f"__block.{c}").alias(c if c == block else f"block_{c}") for c in blocks.columns])


def overlapping(q: DataFrame, qid: str, q_span: Span, t: DataFrame, t_span: Span, anti: bool = False, rows: int | None = None) -> DataFrame:
    """q's rows that overlap any target, or none."""
    return _reached(q, q_span, t, t_span, "__hit", rows).where("NOT __hit" if anti else "__hit").drop("__hit")


def annotate_sets(q: DataFrame, qid: str, q_span: Span, t: DataFrame, feature: str, t_span: Span, features: Sequence[str]) -> DataFrame:
    """One row for each query that any set hits, and a 0/1 column for each set; any number of sets."""
    hits = overlap_pairs(q, qid, q_span, t, feature, t_span)
    return hits.groupBy(qid).agg(*[F.max((F.col(feature) == f).cast("int")).alias(f) for f in features])


def group_by_region(t: DataFrame, tid: str, t_span: Span, q: DataFrame, qid: str, q_span: Span) -> DataFrame:
    """(tid, qid): all queries of each target; a target without any has one row with NULL."""
    pairs = overlap_pairs(t, tid, t_span, q, qid, q_span)
    alone = overlapping(t.select(tid, *t_span), tid, t_span, q, q_span, anti=True)
    return pairs.unionByName(alone.select(tid, F.lit(None).cast(dict(pairs.dtypes)[qid]).alias(qid)))


def as_of(q: DataFrame, chrom: str, pos: str, t: DataFrame, t_chrom: str, t_pos: str, value: Column, prev: str = "prev", next_: str = "next", rows: int | None = None, furthest: Column | None = None) -> DataFrame:
    """q with prev, the value of the last target at or before pos, and next, of the first one after it.

    value is a struct whose first field is the target's position. furthest: another struct, whose largest value among the
    targets at or before pos is prev. Chromosomes are cut into segments of about `rows` rows of either side, windows run
    within a segment, and what lies outside comes from a table with one row for each segment; so no task sorts
    a chromosome.
    """
    names = q.columns
    asked = q.select(F.struct(*names).alias("__row"), F.col(chrom).alias("__chrom"), F.col(pos).alias("__pos"))
    marks = t.where(F.col(t_chrom).isNotNull() & F.col(t_pos).isNotNull()).select(F.col(t_chrom).alias("__chrom"), F.col(t_pos).alias("__pos"), value.alias("__mark"), (value if furthest is None else furthest).alias("__far"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    both = segments(both, "__chrom", "__pos", rows).number(both, "__chrom", "__pos")
    ends = both.groupBy("__chrom", "__seg").agg(F.max("__far").alias("__hi"), F.min("__mark").alias("__lo"))
    across = Window.partitionBy("__chrom").orderBy("__seg")
    back = Window.partitionBy("__chrom").orderBy(F.col("__seg").desc())
    outside = ends.select("__chrom", "__seg", F.max("__hi").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__lo").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    up = Window.partitionBy("__chrom", "__seg").orderBy("__pos").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__chrom", "__seg").orderBy(F.col("__pos").desc()).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"__up": F.max("__far").over(up), "__down": F.min("__mark").over(down)}).where("__row IS NOT NULL")
    seen = seen.join(F.broadcast(outside), (seen["__chrom"].eqNullSafe(outside["__chrom"])) & (seen["__seg"].eqNullSafe(outside["__seg"])), "left")
    # a further end may come from before the segment, as ends need not be in the order of starts
    return seen.select("__row.*", F.greatest("__up", "__before").alias(prev), F.coalesce("__down", "__after").alias(next_))


def nearest_region(q: DataFrame, chrom: str, pos: str, t: DataFrame, tid: str, t_span: Span, max_distance: int | None = None, rows: int | None = None) -> DataFrame:
    """q with the nearest of target regions, which may overlap, and its signed distance; ties go to the later region.

    Of regions that start at or before a position the one with the furthest end is the nearest, whatever lies within it;
    it is carried along beside the next start. Of several that hold a position it is the one whose end is furthest; equal
    ends go to the later start, then to the larger id, and regions ahead that start alike to the nearer end, then the smaller id.
    Only regions of the chromosome count, and only those nearer than max_distance. Regions without a base or with a
    missing bound are no targets.
    """
    start, end, own = F.col(t_span[1]), F.col(t_span[2]), F.col(tid).alias("id")
    value, furthest = F.struct(start.alias("start"), end.alias("end"), own), F.struct(end.alias("end"), start.alias("start"), own)
    found = as_of(q, chrom, pos, t.where(start < end), t_span[0], t_span[1], value, "__prev", "__next", rows, furthest)
    p = F.col(pos)
    behind = F.when(p < F.col("__prev.end"), F.lit(0)).otherwise(p - F.col("__prev.end"))
    ahead = F.col("__next.start") - p
    back = (behind == 0) | ahead.isNull() | (behind < ahead)
    found = found.withColumns({tid: F.when(F.coalesce(back, F.lit(False)), F.col("__prev.id")).otherwise(F.col("__next.id")), "distance": F.when(F.coalesce(back, F.lit(False)), behind).otherwise(-ahead)})
    if max_distance is not None:
        near = F.abs("distance") < max_distance
        found = found.withColumns({tid: F.when(near, F.col(tid)), "distance": F.when(near, F.col("distance"))})
    return found.drop("__prev", "__next")
