"""Mixing sources to target weights by capped water-filling and seeded repetition; DataFrame operations only.

Each source wants a share of the budget by its weight. Sources whose share is above max_epochs times their
size are clamped there, and what they leave is shared out again by weight until no source is above. A
document is taken floor(target / size of its source) times, and once more if it comes early enough in a
seeded order of its source: the documents whose midpoints in the running sum of sizes lie below the rest of
the target. So the words taken miss the target by half a document at most.

A null source is a source of its own, after all others. Null texts and texts without a word have size 0.
Null ids hash as 0. Of rows with the same id and size any may be taken, as many as it takes; a key that holds many rows
is a few sums and numbers within parts of the table, so no task orders its rows. Sources are ordered in one task, a row
for each. Very long texts count like others. Empty tables give no rows. Names of further columns don't matter to mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Parts of the seeded order whose sums are taken first; only one part of each source is then ordered row by row.
BINS = 4096
PRIME = 2147483647
_SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null gives 0."""
    edge = lambda c: c.rlike(_SPACE).cast("int")
    n = F.size(F.split(text, _SPACE + "+")) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(text.isNull() | (F.length(text) == 0), 0).otherwise(n).cast("long")


def order_hash(key: Column, seed: int = 11) -> Column:
    """A number below PRIME for each key, in arithmetic that every SQL engine shares."""
    a = F.pmod(F.coalesce(key.cast("long"), F.lit(0)), F.lit(PRIME))
    b = (a * 48271 + seed) % PRIME
    c = (b * b + b * 7 + 13) % PRIME
    return (c * 69621 + a + 17) % PRIME


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for a table with one row per source.

    Sources are clamped in the order of size to weight: a source stays clamped if, with all before it
    clamped, its share of what is left is above its cap.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    t = sizes.select(F.col(source).alias("source"), F.col(size).cast("long").alias("source_size"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight"))
    t = t.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"at": F.row_number().over(order), "left": F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    t = t.withColumn("level", F.col("left") / F.col("open")).withColumn("clamped", F.col("weight") * F.col("level") > F.col("cap"))
    t = t.withColumn("first_open", F.min(F.when(~F.col("clamped"), F.struct("at", "level"))).over(everything))
    is_open = F.col("first_open").isNotNull() & (F.col("at") >= F.col("first_open.at"))
    return t.select("source", "source_size", F.when(is_open, F.least(F.col("weight") * F.col("first_open.level"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def repetitions(ws: Workspace, df: DataFrame, key: str, source: str, size: Column, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = 11) -> DataFrame:
    """df's rows with __size, source_size, target and times (how often the mix takes the row).

    df is written once to the shared folder with its sizes, as they cost a pass over the texts. The order
    within a source is cut into BINS parts; whole parts lie above or below the cut. In the part on it, rows of one key and
    size are one cell with a count, and cells are summed up in order; of the one cell on the cut, rows are numbered
    within the parts of the table that were written. So the largest source and the most frequent key are spread like others.
    """
    rank = order_hash(F.col(key), seed)
    # where a row was written, as columns of the table, so that a second read finds the same numbers
    place = {"__file": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}
    rows = ws.keep(df.withColumns({"__size": size, "__rank": rank, "__bin": F.floor(rank * BINS / PRIME).cast("int")} | place), "sized")
    parts = rows.groupBy(F.col(source).alias("source"), F.col("__bin").alias("bin")).agg(F.sum("__size").alias("bin_size"))
    goal = targets(parts.groupBy("source").agg(F.sum("bin_size").alias("size")), "source", "size", weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    below = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("bin_size").over(below), F.lit(0)))
    g = goal.withColumnRenamed("source", "goal_source")
    parts = parts.join(g, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    cut = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("bin_size") > F.col("rest"))
    parts = parts.select(F.col("source").alias("__source"), F.col("bin").alias("__part"), "start", "source_size", "target", "whole", "rest", cut.alias("cut"))
    parts = _with_last(ws, rows.select(F.col(source).alias("__s"), F.col(key).alias("__key"), "__size", "__rank", "__bin", "__file", "__row"), parts)
    rows = rows.join(parts, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bin") == F.col("__part")))
    upto = F.struct("__rank", F.col(key).alias("__key"), "__size", "__row") <= F.struct("last.__rank", "last.__key", "last.__size", "last.__row")
    more = F.when(~F.col("cut"), F.col("start") < F.col("rest")).otherwise(F.col("last").isNotNull() & F.coalesce(upto, F.lit(False)))
    out = rows.withColumn("times", F.col("whole") + more.cast("int"))
    return out.drop("__source", "__part", "__rank", "__bin", "__file", "__row", "start", "whole", "rest", "cut", "last")


def _with_last(ws: Workspace, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """parts with last: in the part on the cut, the last row that is taken, by rank, key, size and the row's number.

    Only narrow columns are looked at. The rows that are taken are the first ones in that order, as midpoints rise with it.
    """
    here = parts.where("cut").select("__source", "__part", "start", "rest")
    near = rows.join(here, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__bin") == F.col("__part"))).drop("__s", "__bin")
    keys = ["__source", "__rank", "__key", "__size"]
    cells = near.groupBy(*keys, "start", "rest").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__source").orderBy("__rank", F.col("__key").asc_nulls_first(), "__size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("start") + F.coalesce(F.sum(F.col("__n") * F.col("__size")).over(order), F.lit(0))
    # row i of a cell is taken if 2 (begin + i size) + size < 2 rest
    fits = F.when(F.col("__size") > 0, F.ceil((F.col("rest") - begin) / F.col("__size") - 0.5)).when(begin < F.col("rest"), F.col("__n")).otherwise(0)
    cells = cells.withColumn("__take", F.least(F.greatest(fits, F.lit(0)), F.col("__n")).cast("long")).where("__take > 0")
    last = cells.groupBy("__source").agg(F.max(F.struct("__rank", "__key", "__size", "__take", "__n")).alias("c"))
    last = ws.keep(last.select("__source", "c.*"), "last")  # one row for each source
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    split = near.alias("r").join(last.where("__take < __n").alias("c"), same).select("r.__source", "r.__file", "r.__row", "c.__take")
    before = Window.partitionBy("__source").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = split.groupBy("__source", "__file").agg(F.count("*").alias("m")).select(F.col("__source").alias("__s"), F.col("__file").alias("__f"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    at = F.row_number().over(Window.partitionBy("__source", "__file").orderBy("__row"))
    split = split.withColumn("at", at).join(ahead, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__file") == F.col("__f")))
    rows_of = split.where("at + ahead <= __take").groupBy(F.col("__source").alias("__s")).agg(F.max("__row").alias("__row"))
    last = last.join(rows_of, F.col("__source").eqNullSafe(F.col("__s")), "left")
    every = F.coalesce("__row", F.lit((1 << 63) - 1))
    last = last.select(F.col("__source").alias("__l"), F.struct("__rank", "__key", "__size", every.alias("__row")).alias("last"))
    return parts.join(last, F.col("__source").eqNullSafe(F.col("__l")) & F.col("cut"), "left").drop("__l")


def mix(ws: Workspace, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """docs with each row as often as the mix takes it, and docs' own columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    picked = repetitions(ws, plain, at[key], at[source], word_count(F.col(at[text])), **how)
    rows = picked.where("times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "times")))
    return rows.select(*[F.col(at[n]).alias(n) for n in names])
