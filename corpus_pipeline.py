"""A training corpus from raw documents: classify, apply rules, drop near duplicates, mix sources, pack.

Each stage is written as Parquet and read again before the next, so an executor that is lost costs one stage's
tasks at most. All stages but the last return the columns of documents, whatever further ones there are and however
they are named; the last returns pieces of sequences.

Null and empty texts fail the base rules, so none gets past the second stage. Nulls in other columns change nothing, and
a null source is a source of its own. Rows without a doc_id are scored and mixed like others, and link with nothing.
Very long texts are read whole. Rows that are repeated in full are near duplicates of each other, and one stays; rows
that share a doc_id but not a text are documents of their own, which stay or go together. Ties are broken by doc_id.
Empty tables give no rows; without labels the classifier keeps everything and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import minhash_dedup, mixing, packing, quality_cnn, quality_rules
from locusframe.llm.graph import with_group
from locusframe.llm.queries import tokenizer_path
from locusframe.llm.shared import Workspace

#: Least similarity of near duplicates, in percent of the union of their shingles.
SIMILAR = 80


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the byte network rejects."""
    return quality_cnn.filter_docs(docs, quality_cnn.train(*_labels(spark, sf_dir)))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or the trees."""
    return quality_rules.filter_docs(docs, quality_rules.train(*_labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; of rows with its doc_id and the same text one, and all rows without a doc_id."""
    ws, names = Workspace(spark), docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of a column is one of those added here
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    found = minhash_dedup.near_duplicates(ws, own, key, text, percent=SIMILAR)
    kept = ws.keep(found.where("key = component_id").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("rows")), "kept")
    rows = with_group(ws, own, kept, key, "rows", max(1, own.count()))
    once = rows.where("rows = 1").select(own.columns)
    # few: rows that share their doc_id, of which equal texts come once
    several = rows.where("rows > 1").withColumn("text_hash", F.xxhash64(text)).dropDuplicates([key, "text_hash"]).select(own.columns)
    return once.unionByName(several).unionByName(own.where(F.col(key).isNull())).toDF(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources near their target shares."""
    return mixing.mix(Workspace(spark), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences; one row for each piece."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = ws.keep(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if i:
            ws.drop(docs)
        docs = after
    return docs
