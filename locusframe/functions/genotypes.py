"""Expressions over genotypes (arrays of 0, 1, 2 or NULL) and haplotypes (arrays of 64-bit words, first haplotype lowest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_dosages(dosages: Column | str) -> Column:
    """Two bits for each sample, four samples in a byte, first sample lowest: 0 is 00, missing 01, 1 is 10, 2 is 11."""
    d = _c(dosages)
    code = lambda i: F.when(i >= F.size(d), 0).when(F.get(d, i) == 0, 0).when(F.get(d, i) == 1, 2).when(F.get(d, i) == 2, 3).otherwise(1)
    byte = lambda b: code(b * 4) + code(b * 4 + 1) * 4 + code(b * 4 + 2) * 16 + code(b * 4 + 3) * 64
    hexes = F.transform(F.sequence(F.lit(0), F.ceil(F.size(d) / 4).cast("int") - 1), lambda b: F.lpad(F.hex(byte(b)), 2, "0"))
    return F.when(F.size(d) > 0, F.unhex(F.array_join(hexes, ""))).when(d.isNotNull(), F.unhex(F.lit("")))


def unpack_dosages(data: Column | str, n: Column | int) -> Column:
    """The dosages of the first n samples."""
    h, n = F.hex(_c(data)), n if isinstance(n, Column) else F.lit(n)
    byte = lambda i: F.conv(F.substring(h, F.shiftright(i, 2) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    code = lambda i: F.call_function("shiftright", byte(i), F.pmod(i, F.lit(4)) * 2).bitwiseAND(F.lit(3))
    decoded = lambda i: F.when(code(i) == 0, 0).when(code(i) == 2, 1).when(code(i) == 3, 2)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), decoded)).otherwise(F.array().cast("array<int>"))


def format_dosages(dosages: Column | str) -> Column:
    text = lambda d: F.when(d == 0, "0/0").when(d == 1, "0/1").when(d == 2, "1/1").otherwise("./.")
    return F.array_join(F.transform(_c(dosages), text), ";")


def allele_frequency(dosages: Column | str, skip_missing: bool = False) -> Column:
    """Sum of dosages over twice the samples; NULL with missing ones, or without them counted if they are skipped."""
    d = _c(dosages)
    present = F.filter(d, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0), lambda a, x: a + x).cast("double")
    share = total / F.nullif(2.0 * F.size(present), F.lit(0.0))
    return share if skip_missing else F.when(F.size(present) == F.size(d), share)


def has_missing(dosages: Column | str) -> Column:
    return F.exists(_c(dosages), lambda x: x.isNull())


def filled(dosages: Column | str) -> Column:
    """Missing dosages as 0."""
    return F.transform(_c(dosages), lambda x: F.coalesce(x, F.lit(0)))


def pick(dosages: Column | str, samples: Column) -> Column:
    """The dosages of samples, counted from 1, in that order."""
    return F.transform(samples, lambda i: F.get(_c(dosages), i - 1))


def pack_bits(bits: Column | str) -> Column:
    """0/1 values as 64-bit words."""
    b = _c(bits)
    word = lambda w: F.aggregate(F.slice(b, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("i")), lambda s, v: F.struct(s["x"].bitwiseOR(F.call_function("shiftleft", v.cast("bigint"), s["i"])).alias("x"), (s["i"] + 1).alias("i")), lambda s: s["x"])
    return F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(b) / 64).cast("int") - 1), word)).otherwise(F.array().cast("array<bigint>"))


def unpack_bits(words: Column | str, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    bit = lambda i: F.call_function("shiftrightunsigned", F.get(_c(words), F.shiftright(i, 6)), F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), bit)).otherwise(F.array().cast("array<int>"))


def parse_bits(line: Column | str) -> Column:
    """The 0/1 values of a line of a haplotype file."""
    return F.transform(F.split(F.trim(_c(line)), " +"), lambda x: x.cast("int"))


def format_bits(words: Column | str, n: Column | int) -> Column:
    """A text of 0 and 1 in the order of haplotypes."""
    return F.array_join(F.transform(unpack_bits(words, n), lambda x: x.cast("string")), "")


def pack_bytes(bits: Column | str) -> Column:
    """0/1 values as bytes, eight to a byte, first value lowest."""
    b = _c(bits)
    one = lambda i, k: F.when(i + k < F.size(b), F.get(b, i + k)).otherwise(F.lit(0)) * (1 << k)
    byte = lambda j: sum((one(j * 8, k) for k in range(1, 8)), one(j * 8, 0)).cast("int")
    hexes = F.transform(F.sequence(F.lit(0), F.ceil(F.size(b) / 8).cast("int") - 1), lambda j: F.lpad(F.hex(byte(j)), 2, "0"))
    return F.when(F.size(b) > 0, F.unhex(F.array_join(hexes, ""))).when(b.isNotNull(), F.unhex(F.lit("")))


def planes(dosages: Column | str) -> Column:
    """Dosages as bits of 64-bit words: low where it is 1, high where it is 2, and present where it isn't missing."""
    bits = lambda f: pack_bits(F.transform(_c(dosages), lambda x: F.coalesce(f(x).cast("int"), F.lit(0))))
    return F.struct(bits(lambda x: x == 1).alias("low"), bits(lambda x: x == 2).alias("high"), bits(lambda x: x.isNotNull()).alias("present"))


def _common(x: Column, y: Column) -> Column:
    """Bits set in both; of arrays of unlike lengths what the shorter one lacks is not set."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(F.bit_count(a.bitwiseAND(b)), F.lit(0))), F.lit(0).cast("bigint"), lambda s, n: s + n)


def plane_covariance(x: Column | str, y: Column | str) -> Column:
    """As dosage_covariance, of planes: sums and products over samples that both have are counts of common bits."""
    x, y = _c(x), _c(y)
    n = _common(x["present"], y["present"]).cast("double")
    total = lambda a, b: (_common(a["low"], b["present"]) + 2 * _common(a["high"], b["present"])).cast("double")
    dot = _common(x["low"], y["low"]) + 2 * (_common(x["low"], y["high"]) + _common(x["high"], y["low"])) + 4 * _common(x["high"], y["high"])
    return F.when(n > 1, (n * dot - total(x, y) * total(y, x)) / F.nullif(n * (n - 1.0), F.lit(0.0)))


def dosage_covariance(x: Column | str, y: Column | str) -> Column:
    """Sample covariance of two dosage arrays over the samples that both have; NULL with fewer than two."""
    both = F.filter(F.arrays_zip(_c(x).alias("a"), _c(y).alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda s, v: s + v)
    n = F.size(both).cast("double")
    dot, sx, sy = total(lambda p: (p["a"] * p["b"]).cast("double")), total(lambda p: p["a"].cast("double")), total(lambda p: p["b"].cast("double"))
    return F.when(n > 1, (n * dot - sx * sy) / F.nullif(n * (n - 1.0), F.lit(0.0)))


def popcount(words: Column | str) -> Column:
    return F.aggregate(_c(words), F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))


def shared_bits(x: Column | str, y: Column | str) -> Column:
    """Number of haplotypes set in both."""
    return popcount(F.zip_with(_c(x), _c(y), lambda a, b: a.bitwiseAND(b)))


def covariance(n: Column | int, dot: Column, sx: Column, sy: Column) -> Column:
    """Sample covariance of two 0/1 vectors from their sums and the number of common ones."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("double")
    return (n * dot - sx * sy) / (n * (n - 1.0))
