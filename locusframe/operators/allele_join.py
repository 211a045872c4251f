"""Joins of variants with a reference panel by position and alleles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import is_reversed, is_strand_ambiguous, match_code


def position_match(q: DataFrame, qid: str, t: DataFrame, tid: str, on: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """(qid, tid): the smallest target at each query's position, whatever its alleles; NULL without one."""
    first = t.groupBy(*on).agg(F.min(tid).alias(tid))
    return q.select(qid, *on).join(first, list(on), "left").select(qid, tid)


def _best(q: DataFrame, qid: str, t: DataFrame, tid: str, on: Sequence[str], ref: str, alt: str, carry: Sequence[str]) -> DataFrame:
    """(qid, row, m): each query's row and the least of (match code, tid, carry) over the targets at its position that it matches."""
    tl = t.select(*on, F.col(ref).alias("__tr"), F.col(alt).alias("__ta"), F.col(tid).alias("__tid"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    rows = q.select(*on, F.struct(*q.columns).alias("row"))
    pairs = rows.join(tl, list(on), "left").withColumn("__code", match_code(F.col("row")[ref], F.col("row")[alt], "__tr", "__ta"))
    found = F.when(F.col("__code").isNotNull(), F.struct("__code", "__tid", *[f"__c_{c}" for c in carry]))
    return pairs.groupBy(F.col("row")[qid].alias("__q")).agg(F.min(found).alias("m"), F.first("row").alias("row"))


def best_match(q: DataFrame, qid: str, t: DataFrame, tid: str, on: Sequence[str] = ("chrom", "pos"), ref: str = "ref", alt: str = "alt", carry: Sequence[str] = ()) -> DataFrame:
    """(qid, match_code, tid, carry): the target with the lowest match code, then the smallest id; NULLs without one.

    All targets at the position are held against the query. The best is a minimum of structs, which is
    aggregated before any shuffle. Queries are told apart by qid.
    """
    found = _best(q.select(qid, *on, ref, alt), qid, t, tid, on, ref, alt, carry)
    return found.select(F.col("__q").alias(qid), F.col("m.__code").alias("match_code"), F.col("m.__tid").alias(tid), *[F.col(f"m.__c_{c}").alias(c) for c in carry])


def left_join(q: DataFrame, qid: str, t: DataFrame, tid: str, suffix: str = "_ref", on: Sequence[str] = ("chrom", "pos"), ref: str = "ref", alt: str = "alt") -> DataFrame:
    """q with its best target's columns, under their names with a suffix; rows and targets meet once."""
    others = [c for c in t.columns if c != tid]
    found = _best(q, qid, t, tid, on, ref, alt, others)
    return found.select("row.*", F.col("m.__code").alias("match_code"), F.col("m.__tid").alias(tid), *[F.col(f"m.__c_{c}").alias(f"{c}{suffix}") for c in others])


def align_reference(q: DataFrame, qid: str, panel: DataFrame, tid: str, on: Sequence[str] = ("chrom", "pos"), ref: str = "ref", alt: str = "alt") -> DataFrame:
    """q with match_code and tid of its best row of a panel, NULL without one."""
    return _best(q, qid, panel, tid, on, ref, alt, ()).select("row.*", F.col("m.__code").alias("match_code"), F.col("m.__tid").alias(tid))


def harmonise(gwas: DataFrame, qid: str, panel: DataFrame, tid: str, effects: Sequence[str] = ("beta",), remove_ambiguous: bool = True, remove_missing: bool = True, compat: bool = False) -> DataFrame:
    """gwas with its match in the panel, effects negated where alleles are swapped.

    compat negates effects for all but swapped matches instead, and for rows without a match.
    """
    rows = gwas.where(~is_strand_ambiguous("ref", "alt")) if remove_ambiguous else gwas
    out = align_reference(rows, qid, panel, tid)
    swapped = F.coalesce(is_reversed("match_code"), F.lit(False))
    turn = ~swapped if compat else swapped
    out = out.withColumns({e: F.when(turn, -F.col(e)).otherwise(F.col(e)) for e in effects})
    return out.where("match_code IS NOT NULL") if remove_missing else out


def panel_flip(q: DataFrame, qid: str, panel: DataFrame, on: Sequence[str] = ("chrom", "pos"), pair: str = "alleles") -> DataFrame:
    """(qid, flip): 1, -1 or 0 for allele texts against the panel's; 0 without a row at the position, the largest size of several."""
    from ..functions.alleles import flip_code

    found = q.select(qid, *on, pair).join(panel.select(*on, F.col(pair).alias("__pair")), list(on)).groupBy(qid).agg(F.max_by(flip_code(pair, "__pair"), F.struct(F.abs(flip_code(pair, "__pair")), flip_code(pair, "__pair"))).alias("flip"))
    return q.select(qid).join(found, qid, "left").select(qid, F.coalesce("flip", F.lit(0)).alias("flip"))


def by_id(df: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """df's rows whose key is among ids, or is not."""
    return df.join(ids.select(key), key, "left_anti" if anti else "left_semi")


def by_id_complete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """As by_id; an error if any id is missing from df."""
    all_there = ids.select(key).distinct().join(df.select(key, F.lit(True).alias("__there")).distinct(), key, "left")
    checked = all_there.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return df.join(checked.select(key), key, "left_semi")
