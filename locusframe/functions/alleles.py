"""Expressions over alleles as sets of bases: bit 1 is A, 2 is C, 4 is G, 8 is T; 15 is any base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters of the sets 1 to 15.
LETTERS = "ACMGRSVTWYHKDBN"
#: Names of the match codes 1 to 8.
MATCHES = ["perfect_match", "reverse_match", "complement_match", "reverse_complement_match", "ambig_match", "reverse_ambig_match", "complement_ambig_match", "reverse_complement_ambig_match"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_of(letter: Column | str) -> Column:
    """The set of a text's first letter, in either case; U counts as T; others are NULL."""
    first = F.translate(F.upper(F.substring(_c(letter), 1, 1)), "U", "T")
    at = F.call_function("locate", first, F.lit(LETTERS))
    return F.when((first != "") & (at > 0), at).cast("int")


def letter_of(mask: Column | str) -> Column:
    m = _c(mask).cast("int")
    return F.when(m.between(1, 15), F.substring(F.lit(LETTERS), m, F.lit(1)))


def complement(mask: Column | str) -> Column:
    """The set on the other strand: the four bits in reverse."""
    m = _c(mask).cast("int")
    bit = lambda i, to: F.shiftleft(F.shiftright(m, i).bitwiseAND(F.lit(1)), to)
    return bit(0, 3).bitwiseOR(bit(1, 2)).bitwiseOR(bit(2, 1)).bitwiseOR(bit(3, 0))


def union(a: Column | str, b: Column | str) -> Column:
    return _c(a).bitwiseOR(_c(b))


def other(ref: Column | str, both: Column | str) -> Column:
    """The allele of a pair that isn't ref."""
    return _c(ref).bitwiseXOR(_c(both))


def is_strand_ambiguous(ref: Column | str, alt: Column | str) -> Column:
    """A with T, or C with G, either way round."""
    r, a = _c(ref), _c(alt)
    return F.when(r.isin(1, 8), a == 9 - r).when(r.isin(2, 4), a == 6 - r).otherwise(F.when(r.isNotNull() & a.isNotNull(), F.lit(False)))


def match_code(qr, qa, tr, ta) -> Column:
    """1 to 8 for how a query's alleles match a target's, NULL if they don't.

    As they stand, swapped, on the other strand, or both; 4 more if any allele stands for several bases.
    """
    qr, qa, tr, ta = map(_c, (qr, qa, tr, ta))
    hit = lambda a, b: a.bitwiseAND(b) != 0
    bits = lambda a, b, c, d: F.bit_count(a.bitwiseAND(b)) + F.bit_count(c.bitwiseAND(d))
    cr, ca = complement(qr), complement(qa)
    out = None
    for i, (x, y, u, v) in enumerate(((qr, tr, qa, ta), (qr, ta, qa, tr), (cr, tr, ca, ta), (cr, ta, ca, tr))):
        code = F.when(bits(x, y, u, v) == 2, i + 1).otherwise(i + 5)
        out = F.when(hit(x, y) & hit(u, v), code) if out is None else out.when(hit(x, y) & hit(u, v), code)
    return out


def match_label(code: Column | str) -> Column:
    """The name of a code; NULL for other numbers."""
    return F.when(_c(code).between(1, len(MATCHES)), F.element_at(F.array(*[F.lit(m) for m in MATCHES]), _c(code)))


def is_reversed(code: Column | str) -> Column:
    return _c(code).isin(2, 6)


def strand_flip(pair: Column | str, reverse: bool = False) -> Column:
    """"A,C" on the other strand, and swapped if asked for; NULL for texts that aren't three letters."""
    t = F.translate(_c(pair), "ATCG", "TAGC")
    return F.when(F.length(_c(pair)) == 3, F.reverse(t) if reverse else t)


def flip_code(query: Column | str, target: Column | str) -> Column:
    """1, -1 or 0 for two texts "R,A": alike or flipped and swapped, swapped or flipped, neither.

    Pairs of equal letters, and texts of other lengths that differ, give 0; other lengths that are equal give 1.
    """
    q, t = _c(query), _c(target)
    swapped, turned = F.reverse(q), F.translate(q, "ATCG", "TAGC")
    three = (F.length(q) == 3) & (F.length(t) == 3)
    same = F.substring(q, 1, 1) == F.substring(q, 3, 1)
    coded = F.when(same, 0).when(q == t, 1).when(swapped == t, -1).when(turned == t, -1).when(F.reverse(turned) == t, 1).otherwise(0)
    return F.when(three, coded).otherwise(F.when(q == t, 1).otherwise(0))
