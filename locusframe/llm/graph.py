"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node, summed up before the shuffle, and a join of edges with the minimum of their node.
Nodes that hold more than 1 / HUBS of all edges, which are fewer than HUBS by that, get theirs by broadcast, so no task
holds a large node's neighbourhood; with FEW edges or less, which are counted first, all do. The number of rows never
exceeds twice the number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

HUBS = 1000
#: Rows up to which a table with at most one row for each of them is sent to all tasks.
FEW = 200_000


def with_group(ws: Workspace, rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, few: int = 0) -> DataFrame:
    """rows joined with the one row of groups that has their key, a long; size counts the rows of a key, total all of them.

    Keys with more than total / HUBS rows are fewer than HUBS, so theirs are sent to all tasks, and their rows are not
    shuffled; all others meet in a shuffle. Up to `few` rows, which bound the groups, all groups are sent.
    """
    if total <= few:
        return rows.join(F.broadcast(groups), key)
    groups = ws.keep(groups, "groups")
    hot = [r[0] for r in groups.where(F.col(size) * HUBS > total).select(key).collect()]  # fewer than HUBS
    if not hot:
        return rows.join(groups.hint("merge"), key)
    own = F.col(key).isin(hot)
    rest = rows.where(~own).join(groups.where(~own).hint("merge"), key)
    return rows.where(own).join(F.broadcast(groups.where(own)), key).unionByName(rest)


def _down(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()


def _files(rows: int) -> int:
    """Files for a table of at most `rows` rows."""
    return 8 + rows // 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    edges holds two columns of longs; direction, loops and repeated rows don't matter, nulls are left out.
    Without edges the result is empty.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = ws.keep(_down(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "u", "v"), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = ws.keep(_down(with_group(ws, both.where("v > u"), least, "u", "n", 2 * before[0], FEW), "v", "m").coalesce(_files(before[0])), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_group(ws, large, smallest, "u", "n", before[0], FEW).select("v", "m").unionByName(smallest.select(F.col("u").alias("v"), "m"))
        after = ws.keep(_down(small, "v", "m").coalesce(_files(before[0])), "edges")
        ws.drop(now, large)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
