"""Variants and regions as struct columns, and back; columns found by their type; replacing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alleles import letter_of, mask_of
from ..functions.coords import chrom_code, pack_region, pack_variant, parse_region, parse_variant, unpack_region, unpack_variant

#: All bases, for an allele that isn't given.
ANY = 15
_VARIANT, _REGION = ["chrom", "pos", "ref", "alt"], ["chrom", "start", "end"]


def _is(field: T.StructField, names: list[str]) -> bool:
    return isinstance(field.dataType, T.StructType) and field.dataType.names == names


def variant_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is(f, _VARIANT)]


def region_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is(f, _REGION)]


def is_variant(df: DataFrame, column: str) -> bool:
    return column in variant_columns(df)


def is_region(df: DataFrame, column: str) -> bool:
    return column in region_columns(df)


def _struct(parts: dict[str, Column], names: list[str]) -> Column:
    made = F.struct(*[parts[n].alias(n) for n in names])
    return F.when(parts[names[1]].isNotNull() & parts["chrom"].isNotNull(), made)


def as_variant(df: DataFrame, column: str) -> Column:
    """A column as a variant struct: from text, from the packed long, or as it is; NULL where it isn't one."""
    if is_variant(df, column):
        return F.col(column)
    return _struct(parse_variant(column) if dict(df.dtypes)[column] == "string" else unpack_variant(column), _VARIANT)


def as_region(df: DataFrame, column: str) -> Column:
    """A column as a region struct: from text, from the packed long, from a variant struct (its one base), or as it is."""
    if is_region(df, column):
        return F.col(column)
    if is_variant(df, column):
        return region_of_variant(column)
    return _struct(parse_region(column) if dict(df.dtypes)[column] == "string" else unpack_region(column), _REGION)


def as_packed(df: DataFrame, column: str) -> Column:
    """A variant or region struct as its packed long."""
    v = F.col(column)
    return pack_variant(*[v[n] for n in _VARIANT]) if is_variant(df, column) else pack_region(*[v[n] for n in _REGION])


def as_allele(df: DataFrame, name: str) -> Column:
    """A column as sets: texts by their first letter, numbers as they are."""
    return mask_of(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("int")


def compact_variants(df: DataFrame, chrom: str = "chrom", pos: str = "pos", ref: str | None = "ref", alt: str | None = "alt", out: str = "variant", remove: bool = True) -> DataFrame:
    """df with its columns folded into one struct; alleles that are None or missing stand for any base."""
    c = chrom_code(chrom) if dict(df.dtypes)[chrom] == "string" else F.col(chrom).cast("int")
    allele = lambda x: F.coalesce(as_allele(df, x), F.lit(ANY)) if x and x in df.columns else F.lit(ANY)
    made = df.withColumn("__v", F.struct(c.alias("chrom"), F.col(pos).cast("bigint").alias("pos"), allele(ref).alias("ref"), allele(alt).alias("alt")))
    if remove:
        made = made.drop(chrom, pos, *[x for x in (ref, alt) if x])
    return made.withColumnRenamed("__v", out)


def explode_variants(df: DataFrame, column: str = "variant", letters: bool = False, remove: bool = True) -> DataFrame:
    """df with chrom, pos, ref and alt of a struct; as letters they are named ascii_ref and ascii_alt."""
    v = F.col(column)
    alleles = {"ascii_ref": letter_of(v["ref"]), "ascii_alt": letter_of(v["alt"])} if letters else {"ref": v["ref"], "alt": v["alt"]}
    made = df.select("*", v["chrom"].alias("chrom"), v["pos"].alias("pos"), *[c.alias(k) for k, c in alleles.items()])
    return made.drop(column) if remove else made


def compact_regions(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", out: str = "region", remove: bool = True) -> DataFrame:
    c = chrom_code(chrom) if dict(df.dtypes)[chrom] == "string" else F.col(chrom).cast("int")
    made = df.withColumn("__r", F.struct(c.alias("chrom"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end")))
    return (made.drop(chrom, start, end) if remove else made).withColumnRenamed("__r", out)


def explode_regions(df: DataFrame, column: str = "region", remove: bool = True) -> DataFrame:
    r = F.col(column)
    made = df.select("*", *[r[x].alias(x) for x in _REGION])
    return made.drop(column) if remove else made


def region_of_variant(column: str = "variant") -> Column:
    """The one-base region of a variant."""
    v = F.col(column)
    return F.when(v.isNotNull(), F.struct(v["chrom"].alias("chrom"), v["pos"].alias("start"), (v["pos"] + 1).alias("end")))


def with_fields(column: str, **values: Column) -> Column:
    """A struct with some fields replaced."""
    out = F.col(column)
    for k, x in values.items():
        out = out.withField(k, x)
    return out


def cleared(column: str = "variant") -> Column:
    """A variant with both alleles set to any base."""
    return with_fields(column, ref=F.lit(ANY), alt=F.lit(ANY))
