"""Rendezvous hashing over weighted shards (Thaler and Ravishankar; weights after Schindelhauer and Schomaker).

A record goes to the shard with the least of -ln(u) / weight, where u is uniform and comes from the record's
key and the shard's number. A new shard only draws the records that it wins; none moves between old shards.

Keys are hashed by their text, so an INT and a BIGINT of one value go to one shard; null keys hash as the empty text.
Of equal costs the lower shard wins. Texts of documents play no part: a null or very long one is placed like any other.
Repeated rows go to the same shard and get slots of their own; a key that holds many rows fills its shard, whose slots
are still numbered by many tasks. Empty tables give no rows. Further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace

SEED = 20240229
PRIME = 2147483647


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard, 0 to len(weights) - 1, that key and the weights decide.

    One MD5 of the key gives two numbers; each shard's own comes from them in arithmetic that every SQL engine shares.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % PRIME

    def cost(parts: Column, shard: int, weight: float) -> Column:
        a = (parts["a"] + parts["b"] * (shard + 1)) % PRIME
        b = (a * 48271 + shard) % PRIME
        c = (b * b + b * 7 + 13) % PRIME
        return -F.log((((c * 69621 + a) % PRIME).cast("double") + 0.5) / F.lit(float(PRIME))) / F.lit(float(weight))

    def least(parts: Column) -> Column:
        return F.array_min(F.array(*[F.struct(cost(parts, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]))["shard"]

    # through transform, so that the digest is taken once and not for each shard
    return F.transform(F.array(F.struct(part(1).alias("a"), part(9).alias("b"))), least)[0]


def gapless(ws: Workspace, df: DataFrame, group: str, name: str, order: Sequence[str]) -> DataFrame:
    """df with a column that numbers the rows of each group from 0, in ascending order of some columns, nulls first.

    Rows are dealt by ranges of group and order. Each partition starts where those before it end, so a group with any
    share of all rows is numbered by many tasks. Of rows equal in order any may come first.
    """
    part, at, least, n, shift = (_unused(df, x) for x in ("part", "at", "least", "n", "shift"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = ws.keep(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(part, group).agg(F.count("*").alias(n), F.min(at).alias(least))
    starts = runs.select(F.col(part).alias(n), F.col(group).alias(least), (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(least)).alias(shift))
    out = rows.join(starts, (F.col(part) == F.col(n)) & F.col(group).eqNullSafe(F.col(least)))
    return out.withColumn(name, (F.col(at) + F.col(shift)).cast("long")).drop(part, at, least, n, shift)


def _unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", seed: int = SEED) -> DataFrame:
    """df with its shard; one narrow pass, no shuffle."""
    return df.withColumn(out, rendezvous(F.col(key), weights, seed))
