"""Expressions over coordinates: packing, parsing, formatting, interval predicates, distances.

A variant is (chrom INT, pos BIGINT, ref INT, alt INT) with alleles as 4-bit sets; a region is half-open
(chrom INT, start BIGINT, end BIGINT). Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the sex chromosomes and the largest code.
CHROM_X, CHROM_Y = 23, 24
#: Bits of the packed layouts.
POS_AT, CHROM_AT, REF_AT, START_AT = 16, 58, 8, 29
#: The letters of alleles in texts of variants.
IUPAC = "ACGTMRWSYKVHDBN"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- chromosomes, identifiers


def chrom_code(label: Column | str) -> Column:
    """1 to 24 from a label with or without chr; X and Y are 23 and 24; anything else is NULL."""
    bare = F.upper(F.regexp_replace(_c(label).cast("string"), "^(?i)chr", ""))
    code = F.when(bare == "X", CHROM_X).when(bare == "Y", CHROM_Y).otherwise(F.when(bare.rlike("^[0-9]{1,2}$"), bare.cast("int")))
    return F.when(code.between(1, CHROM_Y), code)


def chrom_label(code: Column | str) -> Column:
    c = _c(code)
    return F.when(c.between(1, 22), F.concat(F.lit("chr"), c.cast("string"))).when(c == CHROM_X, "chrX").when(c == CHROM_Y, "chrY")


def rsid_number(text: Column | str) -> Column:
    """The digits after rs as a number; NULL for other texts."""
    found = F.regexp_extract(_c(text), "^rs([0-9]+)", 1)
    return F.when(found != "", found.try_cast("bigint"))


def rsid_text(number: Column | str) -> Column:
    return F.concat(F.lit("rs"), _c(number).cast("string"))


# ---- packing


def pack_variant(chrom="chrom", pos="pos", ref="ref", alt="alt") -> Column:
    """chrom, pos, ref and alt in one BIGINT that sorts like the four columns; NULL where a field doesn't fit."""
    c, p, r, a = (_c(x).cast("bigint") for x in (chrom, pos, ref, alt))
    packed = F.shiftleft(c, CHROM_AT).bitwiseOR(F.shiftleft(p, POS_AT)).bitwiseOR(F.shiftleft(r, REF_AT)).bitwiseOR(a)
    return F.when(c.between(1, 31) & p.between(1, (1 << 42) - 1) & r.between(0, 255) & a.between(0, 255), packed)


def unpack_variant(packed: Column | str) -> dict[str, Column]:
    k = _c(packed)
    part = lambda at, bits: F.shiftrightunsigned(k, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return {"chrom": part(CHROM_AT, 6).cast("int"), "pos": part(POS_AT, 42), "ref": part(REF_AT, 8).cast("int"), "alt": part(0, 8).cast("int")}


def pack_region(chrom="chrom", start="start", end="end") -> Column:
    c, s, e = (_c(x).cast("bigint") for x in (chrom, start, end))
    packed = F.shiftleft(c, CHROM_AT).bitwiseOR(F.shiftleft(s, START_AT)).bitwiseOR(e)
    return F.when(c.between(1, 31) & s.between(0, (1 << 29) - 1) & e.between(0, (1 << 29) - 1), packed)


def unpack_region(packed: Column | str) -> dict[str, Column]:
    k = _c(packed)
    part = lambda at, bits: F.shiftrightunsigned(k, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return {"chrom": part(CHROM_AT, 6).cast("int"), "start": part(START_AT, 29), "end": part(0, 29)}


def unpack_legacy_variant(packed: Column | str) -> dict[str, Column]:
    """Fields of the older layout: alleles in the two highest bytes, then 43 bits of position, then 5 of chromosome."""
    k = _c(packed)
    part = lambda at, bits: F.shiftrightunsigned(k, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return {"chrom": part(0, 5).cast("int"), "pos": part(5, 43), "ref": part(48, 8).cast("int"), "alt": part(56, 8).cast("int")}


# ---- text

VARIANT_PATTERN = rf"^(?:chr)?([0-9XY]+):([0-9]+)[-_:]([{IUPAC}])[{IUPAC}]*[-_:]([{IUPAC}])[{IUPAC}]*$"
REGION_PATTERN = r"^(?:chr)?([0-9XY]+):([0-9]+)[-_:]([0-9]+)$"


def parse_variant(text: Column | str) -> dict[str, Column]:
    """chrom, pos and the first base of each allele as a set; all NULL where the text isn't a variant."""
    from .alleles import mask_of

    t = _c(text)
    fits = t.rlike(VARIANT_PATTERN)
    part = lambda i: F.when(fits, F.regexp_extract(t, VARIANT_PATTERN, i))
    return {"chrom": chrom_code(part(1)), "pos": F.nullif(part(2).try_cast("bigint"), F.lit(0)), "ref": mask_of(part(3)), "alt": mask_of(part(4))}


def parse_region(text: Column | str) -> dict[str, Column]:
    t = _c(text)
    fits = t.rlike(REGION_PATTERN)
    part = lambda i: F.when(fits, F.regexp_extract(t, REGION_PATTERN, i))
    return {"chrom": chrom_code(part(1)), "start": F.nullif(part(2).try_cast("bigint"), F.lit(0)), "end": F.nullif(part(3).try_cast("bigint"), F.lit(0))}


def format_variant(chrom="chrom", pos="pos", ref="ref", alt="alt") -> Column:
    """chr{chrom}:{pos}_{ref}_{alt} with numbers for all chromosomes; a missing allele prints NA."""
    from .alleles import letter_of

    letters = [F.coalesce(letter_of(x), F.lit("NA")) for x in (ref, alt)]
    return F.concat(F.lit("chr"), _c(chrom).cast("string"), F.lit(":"), _c(pos).cast("string"), F.lit("_"), letters[0], F.lit("_"), letters[1])


def format_region(chrom="chrom", start="start", end="end") -> Column:
    return F.concat(F.lit("chr"), _c(chrom).cast("string"), F.lit(":"), _c(start).cast("string"), F.lit("_"), _c(end).cast("string"))


def format_spdi(sequence: Column | str, pos: Column | str, deleted: Column | str, inserted: Column | str) -> Column:
    return F.concat_ws(":", _c(sequence), _c(pos).cast("string"), _c(deleted), _c(inserted))


# ---- intervals


def overlaps(c1, s1, e1, c2, s2, e2, closed: bool = False) -> Column:
    """Whether two regions overlap; closed counts touching ends, as for regions with both ends inside."""
    c1, s1, e1, c2, s2, e2 = map(_c, (c1, s1, e1, c2, s2, e2))
    return (c1 == c2) & ((s1 <= e2) & (s2 <= e1) if closed else (s1 < e2) & (s2 < e1))


def contains(c1, s1, e1, c2, s2, e2) -> Column:
    """Whether the first region holds the second."""
    c1, s1, e1, c2, s2, e2 = map(_c, (c1, s1, e1, c2, s2, e2))
    return (c1 == c2) & (s1 <= s2) & (e2 <= e1)


def holds(c1, s1, e1, c2, pos) -> Column:
    c1, s1, e1, c2, pos = map(_c, (c1, s1, e1, c2, pos))
    return (c1 == c2) & (s1 <= pos) & (pos < e1)


def between(c, p, lc, lp, rc, rp) -> Column:
    """Whether a position lies strictly between two others of its chromosome."""
    c, p, lc, lp, rc, rp = map(_c, (c, p, lc, lp, rc, rp))
    return (c == lc) & (c == rc) & (lp < p) & (p < rp)


def relative_position(p, lp, rp) -> Column:
    p, lp, rp = map(_c, (p, lp, rp))
    return (p - lp) / F.nullif((rp - lp).cast("double"), F.lit(0.0))


def variant_holds(c1, p1, c2, s2, e2) -> Column:
    """Whether a variant's one base is all of a region."""
    c1, p1, c2, s2, e2 = map(_c, (c1, p1, c2, s2, e2))
    return (c1 == c2) & (s2 == p1) & (e2 == p1 + 1)


def boundary_positions(start="start", end="end") -> dict[str, Column]:
    """The first position of a region, the last one inside, and the one after it."""
    return {"first": _c(start), "last": _c(end) - 1, "after": _c(end)}


def joined_region(c1, s1, e1, c2, s2, e2) -> tuple[Column, Column]:
    """(start, end) of the region from the earlier start to the end of the later region; NULL across chromosomes and where a gap lies between."""
    c1, s1, e1, c2, s2, e2 = map(_c, (c1, s1, e1, c2, s2, e2))
    first = F.least(F.struct(s1.alias("s"), e1.alias("e")), F.struct(s2.alias("s"), e2.alias("e")))
    second = F.greatest(F.struct(s1.alias("s"), e1.alias("e")), F.struct(s2.alias("s"), e2.alias("e")))
    fine = (c1 == c2) & (first["e"] >= second["s"])
    return F.when(fine, first["s"]), F.when(fine, second["e"])


def shifted(start="start", end="end", offset: Column | int = 0) -> tuple[Column, Column]:
    """(start, end) moved by an offset."""
    o = offset if isinstance(offset, Column) else F.lit(offset)
    return _c(start) + o, _c(end) + o


def starts_before(c1, s1, c2, s2) -> Column:
    """Order by chromosome and then by one coordinate; with ends, whether the first ends before the second."""
    return F.struct(_c(c1), _c(s1).alias("x")) < F.struct(_c(c2), _c(s2).alias("x"))


def distance_variants(c1, p1, c2, p2) -> Column:
    return F.when(_c(c1) == _c(c2), _c(p1) - _c(p2))


def distance_region_variant(c1, s1, e1, c2, p) -> Column:
    """0 inside; from the end for later positions, and negative, from the start, for earlier ones."""
    s1, e1, p = map(_c, (s1, e1, p))
    return F.when(_c(c1) == _c(c2), F.when(p < s1, p - s1).when(p < e1, F.lit(0).cast("bigint")).otherwise(p - e1))


def distance_variant_region(c1, p, c2, s2, e2) -> Column:
    """0 inside; otherwise the position minus the nearer bound."""
    return distance_region_variant(c2, s2, e2, c1, p)


def distance_regions(c1, s1, e1, c2, s2, e2) -> Column:
    """0 if they overlap; from the first region's last position to a later start; negative for an earlier region."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    apart = F.when((s1 < e2) & (s2 < e1), F.lit(0).cast("bigint")).when(s2 >= e1, s2 - (e1 - 1)).otherwise(e2 - s1)
    return F.when(_c(c1) == _c(c2), apart)


def common_region(c1, s1, e1, c2, s2, e2, drop_empty: bool = False) -> tuple[Column, Column]:
    """(start, end) of the intersection; NULL across chromosomes, and if asked for where it is empty."""
    c1, s1, e1, c2, s2, e2 = map(_c, (c1, s1, e1, c2, s2, e2))
    start, end = F.greatest(s1, s2), F.least(e1, e2)
    fine = (c1 == c2) & ((start < end) if drop_empty else F.lit(True))
    return F.when(fine, start), F.when(fine, end)


def spanning_region(c1, p1, c2, p2) -> tuple[Column, Column]:
    """(start, end) of the smallest region with both positions."""
    same = _c(c1) == _c(c2)
    return F.when(same, F.least(p1, p2)), F.when(same, F.greatest(p1, p2) + 1)


def width(start="start", end="end") -> Column:
    return _c(end) - _c(start)


def midpoint(start="start", end="end") -> Column:
    """start plus half the width, halves rounded to even."""
    return _c(start) + F.bround((_c(end) - _c(start)) / 2.0).cast("bigint")
