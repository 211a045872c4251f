"""The expression library as temporary SQL functions, whose bodies Spark puts in place of their calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .alleles import LETTERS, MATCHES
from .coords import CHROM_AT, CHROM_X, CHROM_Y, POS_AT, REF_AT, REGION_PATTERN, START_AT, VARIANT_PATTERN

#: What names start with by default, as some of them are Spark's own, such as contains.
PREFIX = "locus_"

_BARE = "regexp_replace(label, '^(?i)chr', '')"
_ALLELES = "qr INT, qa INT, tr INT, ta INT"
_TWO = "c1 INT, s1 BIGINT, e1 BIGINT, c2 INT, s2 BIGINT, e2 BIGINT"
_REGION, _VARIANT = "STRUCT<chrom: INT, start: BIGINT, end: BIGINT>", "STRUCT<chrom: INT, pos: BIGINT, ref: INT, alt: INT>"


def _part(pattern: str, i: int) -> str:
    return f"CASE WHEN t RLIKE r'{pattern}' THEN regexp_extract(t, r'{pattern}', {i}) END"


def _match(x: str, y: str, u: str, v: str, i: int) -> str:
    exact = f"bit_count({x} & {y}) + bit_count({u} & {v}) = 2"
    return f"WHEN {x} & {y} <> 0 AND {u} & {v} <> 0 THEN CASE WHEN {exact} THEN {i} ELSE {i + 4} END"


_QR, _QA = "{p}complement(qr)", "{p}complement(qa)"
_MATCHES = " ".join([_match("qr", "tr", "qa", "ta", 1), _match("qr", "ta", "qa", "tr", 2), _match(_QR, "tr", _QA, "ta", 3), _match(_QR, "ta", _QA, "tr", 4)])

#: (name, parameters, type, body); {p} is the prefix. A function stands after those that it calls.
FUNCTIONS = [
    ("chrom_code", "label STRING", "INT", f"CASE WHEN upper({_BARE}) = 'X' THEN {CHROM_X} WHEN upper({_BARE}) = 'Y' THEN {CHROM_Y} WHEN {_BARE} RLIKE '^[0-9]{{{{1,2}}}}$' AND try_cast({_BARE} AS INT) BETWEEN 1 AND {CHROM_Y} THEN try_cast({_BARE} AS INT) END"),
    ("chrom_label", "code INT", "STRING", f"CASE WHEN code BETWEEN 1 AND 22 THEN concat('chr', code) WHEN code = {CHROM_X} THEN 'chrX' WHEN code = {CHROM_Y} THEN 'chrY' END"),
    ("rsid_number", "t STRING", "BIGINT", "try_cast(nullif(regexp_extract(t, '^rs([0-9]+)', 1), '') AS BIGINT)"),
    ("rsid_text", "n BIGINT", "STRING", "concat('rs', n)"),
    ("mask_of", "letter STRING", "INT", f"nullif(CASE WHEN substring(letter, 1, 1) <> '' THEN locate(translate(upper(substring(letter, 1, 1)), 'U', 'T'), '{LETTERS}') END, 0)"),
    ("letter_of", "mask INT", "STRING", f"CASE WHEN mask BETWEEN 1 AND 15 THEN substring('{LETTERS}', mask, 1) END"),
    ("complement", "mask INT", "INT", "shiftleft(mask & 1, 3) | shiftleft(mask & 2, 1) | shiftright(mask & 4, 1) | shiftright(mask & 8, 3)"),
    ("is_strand_ambiguous", "ref INT, alt INT", "BOOLEAN", "CASE WHEN ref IN (1, 8) THEN alt = 9 - ref WHEN ref IN (2, 4) THEN alt = 6 - ref WHEN ref IS NOT NULL AND alt IS NOT NULL THEN false END"),
    ("match_code", _ALLELES, "INT", f"CASE {_MATCHES} END"),
    ("match_label", "code INT", "STRING", "CASE code " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MATCHES, 1)) + " END"),
    ("is_reversed", "code INT", "BOOLEAN", "code IN (2, 6)"),
    ("strand_flip", "pair STRING", "STRING", "CASE WHEN length(pair) = 3 THEN translate(pair, 'ATCG', 'TAGC') END"),
    ("pack_variant", "chrom INT, pos BIGINT, ref INT, alt INT", "BIGINT", f"CASE WHEN chrom BETWEEN 1 AND 31 AND pos BETWEEN 1 AND {(1 << 42) - 1} AND ref BETWEEN 0 AND 255 AND alt BETWEEN 0 AND 255 THEN shiftleft(CAST(chrom AS BIGINT), {CHROM_AT}) | shiftleft(pos, {POS_AT}) | shiftleft(CAST(ref AS BIGINT), {REF_AT}) | CAST(alt AS BIGINT) END"),
    ("pack_region", "chrom INT, s BIGINT, e BIGINT", "BIGINT", f"CASE WHEN chrom BETWEEN 1 AND 31 AND s BETWEEN 0 AND {(1 << 29) - 1} AND e BETWEEN 0 AND {(1 << 29) - 1} THEN shiftleft(CAST(chrom AS BIGINT), {CHROM_AT}) | shiftleft(s, {START_AT}) | e END"),
    ("unpack_variant", "k BIGINT", _VARIANT, f"named_struct('chrom', CAST(shiftrightunsigned(k, {CHROM_AT}) & 63 AS INT), 'pos', shiftrightunsigned(k, {POS_AT}) & {(1 << 42) - 1}L, 'ref', CAST(shiftrightunsigned(k, {REF_AT}) & 255 AS INT), 'alt', CAST(k & 255 AS INT))"),
    ("unpack_region", "k BIGINT", _REGION, f"named_struct('chrom', CAST(shiftrightunsigned(k, {CHROM_AT}) & 63 AS INT), 'start', shiftrightunsigned(k, {START_AT}) & {(1 << 29) - 1}L, 'end', k & {(1 << 29) - 1}L)"),
    ("parse_variant", "t STRING", _VARIANT, "named_struct('chrom', {p}chrom_code({v1}), 'pos', nullif(try_cast({v2} AS BIGINT), 0), 'ref', {p}mask_of({v3}), 'alt', {p}mask_of({v4}))"),
    ("parse_region", "t STRING", _REGION, "named_struct('chrom', {p}chrom_code({r1}), 'start', nullif(try_cast({r2} AS BIGINT), 0), 'end', nullif(try_cast({r3} AS BIGINT), 0))"),
    ("format_variant", "chrom INT, pos BIGINT, ref INT, alt INT", "STRING", "concat('chr', chrom, ':', pos, '_', coalesce({p}letter_of(ref), 'NA'), '_', coalesce({p}letter_of(alt), 'NA'))"),
    ("format_region", "chrom INT, s BIGINT, e BIGINT", "STRING", "concat('chr', chrom, ':', s, '_', e)"),
    ("overlaps", _TWO, "BOOLEAN", "c1 = c2 AND s1 < e2 AND s2 < e1"),
    ("contains", _TWO, "BOOLEAN", "c1 = c2 AND s1 <= s2 AND e2 <= e1"),
    ("holds", "c1 INT, s1 BIGINT, e1 BIGINT, c2 INT, pos BIGINT", "BOOLEAN", "c1 = c2 AND s1 <= pos AND pos < e1"),
    ("distance_variants", "c1 INT, p1 BIGINT, c2 INT, p2 BIGINT", "BIGINT", "CASE WHEN c1 = c2 THEN p1 - p2 END"),
    ("distance_region_variant", "c1 INT, s1 BIGINT, e1 BIGINT, c2 INT, p BIGINT", "BIGINT", "CASE WHEN c1 = c2 THEN CASE WHEN p < s1 THEN p - s1 WHEN p < e1 THEN 0 ELSE p - e1 END END"),
    ("distance_regions", _TWO, "BIGINT", "CASE WHEN c1 = c2 THEN CASE WHEN s1 < e2 AND s2 < e1 THEN 0 WHEN s2 >= e1 THEN s2 - (e1 - 1) ELSE e2 - s1 END END"),
    ("common_region", _TWO, _REGION, "CASE WHEN c1 = c2 THEN named_struct('chrom', c1, 'start', greatest(s1, s2), 'end', least(e1, e2)) END"),
    ("region_width", "s BIGINT, e BIGINT", "BIGINT", "e - s"),
    ("midpoint", "s BIGINT, e BIGINT", "BIGINT", "s + CAST(bround((e - s) / 2.0D) AS BIGINT)"),
]


def register_functions(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Makes each function of FUNCTIONS a temporary one of the session, under its name after a prefix; the names.

    They take columns of any of Spark's SQL clauses that allow SQL functions, and no Python runs for them. Where the
    session has them already they are made anew. Arguments are cast to the types of the parameters; NULL gives what the
    function of this name in coords or alleles gives.
    """
    fields = {f"v{i}": _part(VARIANT_PATTERN, i) for i in range(1, 5)} | {f"r{i}": _part(REGION_PATTERN, i) for i in range(1, 4)}
    made = []
    for name, parameters, kind, body in FUNCTIONS:
        made.append(prefix + name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made[-1]}({parameters}) RETURNS {kind} RETURN {body.format(p=prefix, **fields)}")
    return made
