"""Genomic views of the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view: its table and its select list. Positions are unique; alleles differ; regions are sorted and disjoint.
VARIANTS = ("orders", """o_orderkey AS variant_id, CAST(1+o_custkey%24 AS INT) AS chrom, 1+(o_orderkey*7919)%1000000 AS pos,
 CAST(CASE o_orderkey%4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS INT) AS ref,
 CAST(CASE (o_orderkey+1+o_custkey%3)%4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS INT) AS alt,
 o_totalprice AS beta""")
_SLOT = "(CAST(floor(p_partkey/24) AS BIGINT)*7919)%1000"
REGIONS = ("part", f"""p_partkey AS region_id, CAST(1+p_partkey%24 AS INT) AS chrom, 1+{_SLOT}*1000 AS start_pos,
 1+{_SLOT}*1000+200+p_size*16 AS end_pos""")
WIDE = ("part", f"""p_partkey AS region_id, CAST(1+p_partkey%24 AS INT) AS chrom, 1+{_SLOT}*1000 AS start_pos,
 1+{_SLOT}*1000+(200+p_size*16)*40 AS end_pos""")
_KSLOT = "CAST((CAST(floor(c_custkey/24) AS BIGINT)*7919)%1000 AS DOUBLE)"
KNOTS = ("customer", f"CAST(1+c_custkey%24 AS INT) AS chrom, CAST(1+{_KSLOT}*1000 AS BIGINT) AS pos, {_KSLOT}*0.01+({_KSLOT}%7)*0.001 AS cm")
#: Variants and wide regions spread over 200 million bases, so that rows lie in many segments of a chromosome and between them.
FAR_VARIANTS = (VARIANTS[0], VARIANTS[1].replace("1+(o_orderkey*7919)%1000000 AS pos", "1+((o_orderkey*7919)%1000000)*200 AS pos"))
FAR_WIDE = ("part", f"""p_partkey AS region_id, CAST(1+p_partkey%24 AS INT) AS chrom, 1+{_SLOT}*200000 AS start_pos,
 1+{_SLOT}*200000+(200+p_size*16)*8000 AS end_pos""")
FAR_REGIONS = ("part", f"""p_partkey AS region_id, CAST(1+p_partkey%24 AS INT) AS chrom, 1+{_SLOT}*200000 AS start_pos,
 1+{_SLOT}*200000+(200+p_size*16)*100 AS end_pos""")
FAR_KNOTS = (KNOTS[0], KNOTS[1].replace(f"CAST(1+{_KSLOT}*1000 AS BIGINT) AS pos", f"CAST(1+{_KSLOT}*200000 AS BIGINT) AS pos"))
FEATURES = ("events", "event_id, event_type, CAST(1+user_id%24 AS INT) AS chrom, 1+(event_id*6151)%1000000 AS start_pos, 1+(event_id*6151)%1000000+50+user_id%400 AS end_pos")
#: Panel rows from variants by variant_id modulo 8: same, swapped, other strand, both, any base, one position on, two rows, none.
_COMP = "CASE {x} WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 4 THEN 2 WHEN 8 THEN 1 ELSE 15 END"
_CR, _CA = _COMP.format(x="ref"), _COMP.format(x="alt")
PANEL_OF_VARIANTS = f"""SELECT variant_id AS panel_id, chrom, pos + CASE WHEN variant_id%8=5 THEN 1 ELSE 0 END AS pos,
 CAST(CASE variant_id%8 WHEN 1 THEN alt WHEN 2 THEN {_CR} WHEN 3 THEN {_CA} WHEN 4 THEN 15 ELSE ref END AS INT) AS ref,
 CAST(CASE variant_id%8 WHEN 1 THEN ref WHEN 2 THEN {_CA} WHEN 3 THEN {_CR} WHEN 4 THEN 15 ELSE alt END AS INT) AS alt
 FROM variants WHERE variant_id%8 <> 7
 UNION ALL SELECT variant_id + 100000000 AS panel_id, chrom, pos, alt AS ref, ref AS alt FROM variants WHERE variant_id%8=6"""


def view(spark: SparkSession, sf_dir: str, spec: tuple[str, str]) -> DataFrame:
    table, columns = spec
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def cte(**specs: tuple[str, str]) -> str:
    """The WITH list of named views."""
    return "WITH " + ", ".join(f"{name} AS (SELECT {columns} FROM {table})" for name, (table, columns) in specs.items())


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, VARIANTS)
    a, b = (x.strip() for x in PANEL_OF_VARIANTS.split("UNION ALL"))

    def part(text: str) -> DataFrame:
        columns, where = text.removeprefix("SELECT").split(" FROM variants WHERE ")
        return v.where(where).selectExpr(*_split(columns))

    return part(" ".join(a.split())).unionByName(part(" ".join(b.split())))


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hap_id, block, cm, words, bits): the signs of an embedding's 64 values as 64 haplotypes of one variant."""
    from pyspark.sql import functions as F

    from ..functions.genotypes import pack_bits

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    return e.select(F.col("vec_id").alias("hap_id"), F.col("label").alias("block"), (F.col("vec_id") * 0.001).alias("cm"), bits.alias("bits")).withColumn("words", pack_bits("bits"))


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snp_id, dosages): three thresholds of an embedding; values near 0 in every fifth vector are missing. Vectors without any value have no row.

    Thresholds are of the values' own type, as in SQL: the float next to -0.1 isn't below it, though as a double it is.
    """
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) > 0")
    kind = e.schema["embedding"].dataType.elementType
    of = lambda x: F.lit(x).cast(kind)
    d = F.transform("embedding", lambda x: F.when((F.col("vec_id") % 5 == 0) & (F.abs(x) < of(0.02)), F.lit(None)).when(x < of(-0.1), 0).when(x < of(0.1), 1).otherwise(2))
    return e.select(F.col("vec_id").alias("snp_id"), d.alias("dosages"))


DOSAGES_SQL = """doses AS (SELECT vec_id AS snp_id, CAST(i AS BIGINT) AS sample,
 CASE WHEN vec_id%5=0 AND abs(embedding[i]) < 0.02 THEN NULL WHEN embedding[i] < -0.1 THEN 0 WHEN embedding[i] < 0.1 THEN 1 ELSE 2 END AS d
 FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding)+1)) AS i FROM embeddings))"""
HAPS_SQL = "haps AS (SELECT vec_id AS hap_id, label AS block, vec_id*0.001 AS cm, list_transform(embedding, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS DOUBLE)) AS bits FROM embeddings)"
