"""Readers and writers of the common text formats. Chromosomes are codes 1 to 24, alleles 4-bit sets, rsids numbers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.alleles import letter_of, mask_of
from ..functions.coords import chrom_code, chrom_label, rsid_number, rsid_text
from ..operators.intervals import overlap_pairs, with_point_span


def _schema(**kinds: str) -> T.StructType:
    known = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, known[k]) for n, k in kinds.items()])


BED = _schema(chrom="string", start="bigint", end="bigint")
BIM = _schema(chrom="string", rsid="string", map="double", pos="bigint", alt="string", ref="string")
FAM = _schema(fid="string", iid="string", father_id="string", mother_id="string", sex="int", phenotype="double")
LEGEND = _schema(id="string", position="bigint", a0="string", a1="string")
SAMPLES = _schema(sample="string", population="string", group="string", sex="int")
MAP = _schema(position="bigint", rate="double", map="double", filtered="double")


def read_bed(spark: SparkSession, path: str, more: T.StructType | None = None, header: bool | None = None) -> DataFrame:
    """(chrom, start, end, further columns). header: whether each file's first line is one; by default lines whose start isn't a number are left out."""
    schema = T.StructType(BED.fields + (more.fields if more else []))
    if header is None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        raw = spark.read.csv(path, sep="\t", schema=text, comment="#").where(F.col("start").rlike("^[0-9]+$"))
        rows = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    else:
        rows = spark.read.csv(path, sep="\t", schema=schema, header=header)
    return rows.withColumn("chrom", chrom_code("chrom"))


def write_bed(df: DataFrame, path: str, mode: str = "error") -> None:
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    df.select(chrom_label("chrom").alias("chrom"), "start", "end", *rest).write.mode(mode).csv(path, sep="\t", header=True)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, rsid, map, pos, ref, alt, ref_text, alt_text); labels with or without chr."""
    raw = spark.read.csv(path, sep="\t", schema=BIM)
    return raw.select(chrom_code("chrom").alias("chrom"), "rsid", "map", "pos", mask_of("ref").alias("ref"), mask_of("alt").alias("alt"), F.col("ref").alias("ref_text"), F.col("alt").alias("alt_text"))


def _refuse_unless_scan(plan) -> None:
    """An error unless a plan is one scan of files under projections."""
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() not in ("LogicalRelation", "Relation", "DataSourceV2Relation"):
        raise ValueError(f"rows have line numbers as they are read from files, not after {plan.nodeName()}; number others by ranked")


def with_line_number(df: DataFrame, name: str = "line") -> DataFrame:
    """df, as read from files, with a row number from 0: files in the order of their paths, rows in the order of their file.

    Spark deals splits to partitions by size, so neither partitions nor their order say where a row lies. Rows are
    counted in each split of each file, and each split starts where the ones before it end; the table of splits has
    one row for each split. After a sort, join, union or aggregate a row has no place in a file, so those are refused.
    """
    _refuse_unless_scan(df._jdf.queryExecution().analyzed())
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    before = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = at.groupBy("__file", "__at").agg(F.count("*").alias("n"), F.min("__id").alias("least"))
    splits = splits.select("__file", "__at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("__shift"))
    rows = at.join(splits, ["__file", "__at"])
    return rows.withColumn(name, (F.col("__id") + F.col("__shift")).cast("bigint")).drop("__file", "__at", "__id", "__shift")


def write_bim(df: DataFrame, path: str, mode: str = "append") -> None:
    have = set(df.columns)
    rsid = F.when(F.col("rsid").cast("string").startswith("rs"), F.col("rsid").cast("string")).otherwise(rsid_text("rsid"))
    df.select(F.col("chrom"), rsid.alias("rsid"), (F.col("map") if "map" in have else F.lit(0.0)).alias("map"), "pos", letter_of("alt").alias("alt"), letter_of("ref").alias("ref")).write.mode(mode).csv(path, sep="\t", header=False)


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=FAM)


def write_fam(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(*FAM.names).write.mode(mode).csv(path, sep=" ", header=False)


def chrom_of_path(path: Column) -> Column:
    """The chromosome that a file's name holds."""
    return chrom_code(F.regexp_extract(path, ".*(chr[0-9XY]+)", 1))


def read_legend(spark: SparkSession, path: str, chrom: int | None = None) -> DataFrame:
    """(chrom, rsid, pos, ref, alt); the chromosome is given, or from each file's name. Compressed files are read as they are."""
    raw = spark.read.csv(path, sep=" ", header=True, schema=LEGEND)
    at = F.lit(chrom) if chrom else chrom_of_path(F.input_file_name())
    return raw.select(at.alias("chrom"), rsid_number(F.split("id", ":")[0]).alias("rsid"), F.col("position").alias("pos"), mask_of("a0").alias("ref"), mask_of("a1").alias("alt"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", header=True, schema=SAMPLES)


def read_hap(spark: SparkSession, path: str, keep: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(line, n, words): one row for each line of 0 and 1; keep holds the lines to read.

    With an index of the path's lines (lines.line_index) the byte ranges of keep's lines are read and no others.
    """
    from ..functions.genotypes import pack_bits, parse_bits
    from .lines import read_line_ranges

    if keep is not None and index is not None:
        lines = read_line_ranges(index, keep)
    else:
        lines = with_line_number(spark.read.text(path))
        if keep is not None:
            lines = lines.join(keep.select("line"), "line", "left_semi")
    return lines.withColumn("bits", parse_bits("value")).select("line", F.size("bits").alias("n"), pack_bits("bits").alias("words"))


def read_hap_with_legend(spark: SparkSession, legend_path: str, hap_path: str, chrom: int, where: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Legend rows that `where` keeps, with their haplotypes; line i of one file belongs to line i of the other."""
    legend = with_line_number(read_legend(spark, legend_path, chrom))
    chosen = where(legend) if where else legend
    return chosen.join(read_hap(spark, hap_path, chosen, index), "line")


def hap_by_rsid(spark: SparkSession, legend_path: str, hap_path: str, chrom: int, rsids: DataFrame, index: DataFrame | None = None) -> DataFrame:
    return read_hap_with_legend(spark, legend_path, hap_path, chrom, lambda x: x.join(rsids.select("rsid"), "rsid", "left_semi"), index)


def hap_by_regions(spark: SparkSession, legend_path: str, hap_path: str, chrom: int, regions: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """regions: (chrom, start, end)."""

    def inside(legend: DataFrame) -> DataFrame:
        r = regions.where(F.col("chrom") == chrom).withColumn("__rid", F.monotonically_increasing_id())
        hits = overlap_pairs(with_point_span(legend), "line", ("chrom", "pos", "pos_end"), r, "__rid", ("chrom", "start", "end"))
        return legend.join(hits.select("line"), "line", "left_semi")

    return read_hap_with_legend(spark, legend_path, hap_path, chrom, inside, index)


def hap_over_chromosomes(spark: SparkSession, pattern: str, chroms: Sequence[int], read: Callable[..., DataFrame], rows: DataFrame) -> DataFrame:
    """What read, hap_by_rsid or hap_by_regions, gives for each chromosome of a folder, in one table.

    pattern, as "panel/EUR.chr{chrom}_1kg_geno", gives each chromosome's legend with .legend.gz after it and its
    haplotypes with .hap.gz; parts of other names come as they are where the pattern says {kind}.
    """

    def path(chrom: int, kind: str) -> str:
        name = pattern.format(chrom=chrom, kind=kind)
        return name if "{kind}" in pattern else f"{name}.{kind}.gz"

    parts = [read(spark, path(c, "legend"), path(c, "hap"), c, rows) for c in chroms]
    return functools.reduce(DataFrame.unionByName, parts)


def read_genetic_map(spark: SparkSession, path: str, chrom: int | None = None) -> DataFrame:
    """(chrom, pos, cm) of the rows that aren't marked as filtered; an error for a missing value."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=MAP).where("filtered IS NULL OR filtered <> 1")
    at = F.lit(chrom) if chrom else chrom_of_path(F.input_file_name())
    missing = F.col("position").isNull() | F.col("map").isNull()
    cm = F.when(missing, F.raise_error(F.lit("missing value in a genetic map")).cast("double")).otherwise(F.col("map"))
    return raw.select(at.alias("chrom"), F.col("position").alias("pos"), cm.alias("cm"))
