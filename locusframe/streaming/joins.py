"""Streams of variants against static tables. Each row is matched when it comes, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import match_code
from ..operators.intervals import binned_pair, overlap_pairs, used_levels
from ..operators.islands import disjoin


def regions_of_stream(stream: DataFrame, qid: str, regions: DataFrame, rid: str, chrom: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """(stream's columns, rid): one row for each region that holds the variant; the bins of the regions are a static table."""
    q = stream.withColumns({"__chrom": F.col(chrom), "__qs": F.col(pos).cast("bigint"), "__qe": F.col(pos).cast("bigint") + 1})
    t = regions.select(F.col(rid), F.col(chrom).alias("__chrom"), F.col(start).cast("bigint").alias("__ts"), F.col(end).cast("bigint").alias("__te")).where("__ts < __te")
    q, t = binned_pair(q, t, [0], used_levels(t, "__ts", "__te"))  # a position is of the finest level
    pairs = q.join(t, ["__chrom", "__code", "__bin"])
    return pairs.where("__ts <= __qs AND __qs < __te").select(*stream.columns, rid)


def pieces(regions: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(chrom, start, end, piece): the disjoint pieces of regions, each with its start as its number on the chromosome.

    A stream held against pieces writes a variant once at most, however many regions hold it; regions_of_pieces gives those.
    """
    sound = regions.where((F.col(start) < F.col(end)) & F.col(chrom).isNotNull())
    return disjoin(sound, chrom, start, end).select(chrom, start, end, F.col(start).alias("piece"))


def regions_of_pieces(found: DataFrame, parts: DataFrame, regions: DataFrame, rid: str, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(found's columns, rid): one row for each region that holds the piece of a row."""
    held = overlap_pairs(parts.withColumn("__piece", F.struct(chrom, "piece")), "__piece", (chrom, start, end), regions, rid, (chrom, start, end), within=True)
    held = held.select(F.col(f"__piece.{chrom}").alias("__of"), F.col("__piece.piece").alias("__at"), rid)
    return found.join(held, (F.col(chrom) == F.col("__of")) & (F.col("piece") == F.col("__at"))).drop("__of", "__at")


def matches_of_stream(stream: DataFrame, panel: DataFrame, panel_id: str, on: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """(stream's columns, panel_id, match_code): one row for each row of the panel that a variant matches."""
    t = panel.select(*on, F.col(panel_id), F.col("ref").alias("__tr"), F.col("alt").alias("__ta"))
    found = stream.join(t, list(on)).withColumn("match_code", match_code("ref", "alt", "__tr", "__ta")).where("match_code IS NOT NULL")
    return found.select(*stream.columns, panel_id, "match_code")


def effects_by_window(stream: DataFrame, time: str, late: str, width: str, group: str, value: str) -> DataFrame:
    """Counts and mean absolute values of tumbling windows, with rows later than `late` left out and closed windows freed."""
    at = stream.withWatermark(time, late)
    return at.groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.avg(F.abs(value)).alias("mean_effect"))
