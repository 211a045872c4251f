"""Segments of chromosomes with about equal numbers of rows, wherever rows are dense.

Windows over a chromosome run within segments, and what comes from before a segment is carried into it by a table with one
row for each. Bounds are quantiles of positions: rows are counted by chromosome, and of those with more than a segment
holds a sample, whose size follows the number of segments and not that of rows, goes into a quantile sketch. So two small
aggregates run before the plan is made, the second only for large tables; bounds are a short list for each chromosome. A
row finds its segment by a binary search in its chromosome's list.

Rows at one position are never parted. Where the bounds fall changes no result, only how evenly tasks are loaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a segment is meant to hold, and segments of a chromosome at most.
ROWS, MOST = 1 << 20, 1024
#: Rows of the sample for each segment, and the sketch's accuracy for each.
SAMPLED, ACCURACY = 256, 64


class Segments:
    """bounds: (chromosome, ascending positions that start its second and further segments), for large chromosomes only."""

    def __init__(self, bounds: list[tuple[object, list]], kind: str, pos_kind: str):
        self.bounds, self.kind, self.pos_kind = bounds, kind, pos_kind

    def every(self, n: int) -> Segments:
        """Segments of n of these each."""
        return Segments([(c, b[n - 1 :: n]) for c, b in self.bounds if len(b) >= n], self.kind, self.pos_kind)

    def number(self, df: DataFrame, chrom: str, pos: str, out: str = "__seg") -> DataFrame:
        """df with the number of each row's segment within its chromosome, from 0; a NULL position is in the first one."""
        if not self.bounds:
            return df.withColumn(out, F.lit(0))
        table = df.sparkSession.createDataFrame(self.bounds, f"__of {self.kind}, __bounds array<{self.pos_kind}>")
        steps, n = [], 1
        while n <= max(len(b) for _, b in self.bounds):
            steps, n = [n, *steps], n * 2

        def step(low: Column, by: Column) -> Column:
            return F.when(F.get(F.col("__bounds"), low + by - 1) <= F.col(pos), low + by).otherwise(low)

        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
        joined = df.join(F.broadcast(table), F.col(chrom).eqNullSafe(F.col("__of")), "left")  # a row for each large chromosome
        return joined.withColumn(out, found).drop("__of", "__bounds")


def segments(df: DataFrame, chrom: str, pos: str, rows: int | None = None) -> Segments:
    """Segments of about `rows` rows of df, from its positions."""
    rows = rows or ROWS
    kinds = dict(df.dtypes)
    counts = {r[0]: r[1] for r in df.groupBy(F.col(chrom).alias("c")).agg(F.count(pos)).collect()}
    wanted = {c: min(MOST, -(-n // rows)) for c, n in counts.items() if n > rows}
    if not wanted:
        return Segments([], kinds[chrom], kinds[pos])
    most = max(wanted.values())
    shares = df.sparkSession.createDataFrame([(c, min(1.0, SAMPLED * k / counts[c])) for c, k in wanted.items()], f"__of {kinds[chrom]}, __share double")
    drawn = df.select(F.col(chrom).alias("__c"), F.col(pos).alias("__p")).where("__p IS NOT NULL").join(F.broadcast(shares), F.col("__c").eqNullSafe(F.col("__of"))).where(F.rand(7) < F.col("__share"))
    at = [i / most for i in range(1, most)]
    sketched = drawn.groupBy("__c").agg(F.percentile_approx("__p", at, ACCURACY * most).alias("q")).collect()
    bounds = []
    for c, q in sketched:
        k = wanted[c]
        picked = sorted({q[max(0, round(i * most / k) - 1)] for i in range(1, k)})
        if picked:
            bounds.append((c, picked))
    return Segments(bounds, kinds[chrom], kinds[pos])
