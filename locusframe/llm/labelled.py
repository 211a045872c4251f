"""Labelled rows to learn from: a bounded sample, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from at most; the rest are left out of learning only.
MOST_LABELLED = 3000


def fold(key: Column, n: int = 3) -> Column:
    """crc32 of the key as text, modulo n; null keys are fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def rows(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(docs' columns, __label, __hash) of the rows of at most `most` labelled keys outside fold 1, chosen by a hash of the key.

    The chosen keys are few by this bound, so they are sent to the documents. A key with several labels gets the least.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 1))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.min(label).cast("int").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(most)
    return docs.join(F.broadcast(known), F.col(key) == F.col("__key")).drop("__key").withColumn("__hash", F.xxhash64(*docs.columns))


def least(rows: DataFrame, key: str) -> DataFrame:
    """(key, further columns of rows, __label): of each key's rows the least by a hash of the whole row."""
    rest = [c for c in rows.columns if c not in (key, "__label", "__hash")]
    one = rows.groupBy(key, "__label").agg(F.min(F.struct("__hash", *rest)).alias("__row"))
    return one.select(key, *[F.col("__row")[c].alias(c) for c in rest], "__label")


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(key, docs' other columns, __label) of at most `most` labelled rows outside fold 1; few texts are shuffled."""
    return least(rows(docs, labels, key, label, most), key)
