"""Near duplicates by an inverted join over MinHash signature coordinates.

Documents with the same set of shingles form a class; everything below works on one document of each class. A
class is known by a hash of its set's fingerprint; keys come back in at the end, as the least key of a component.
A class has a signature of K coordinates and is posted under its pairs of coordinate and value. Two classes
whose signatures agree in T coordinates or more are candidates. As in prefix and skip merging, pairs are
ordered by how many classes hold them, a class's K - T + 1 rarest ones are its prefix, two candidates share a
pair of their prefixes, and the long lists of the rest are skipped: their agreement is counted on the
signatures. Classes that share fewer than T of their pairs with any other are out at once.

Pairs are never rows, so groups of copies stay as long as they are. Each list gives one row for each class that
has a candidate there, with the smallest class that candidates reach within the list; components of these rows
are groups of candidates. Every class then goes to its group, with its text, and candidates are confirmed on the full
sets there; again each class gives one row. Lists and groups of more than CHUNK classes are linked in three steps,
which lose nothing, as all that is asked for is who reaches whom: within chunks; between one class of each component
that this found in a chunk; and then all classes outside of the group's largest component against all of the group.
So a class of a large group of copies goes to a task three times or so, and not once for every other chunk. Lists and
groups that hold many of all rows are found by their counts, which are sent to the rows, so no task reads them whole.

T is set so that a pair at the threshold has fewer than 1 in 1,000 chances to be missed: with K = 64 and a
similarity of 0.85, agreement has mean 54.4 and deviation 2.86, and T = 45.

Null texts, and texts without words, have an empty set and link with nothing. Null keys link with nothing and
have a null component. Repeated rows are one class. A key that comes with several texts joins their links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, with_group
from .shared import Workspace
from .texts import Words, blocks, distinct, mix
from .token_ids import forget

K = 64
SHINGLE = 5
#: Classes of a chunk of a long list or group.
CHUNK = 512
#: Rows that a task compares with each other at most by intention.
ROWS = 1 << 13
_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPREAD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SETS = "key long, text_hash long, n_shingles long, fp1 long, fp2 long, sig array<int>"


def least_agreement(percent: int, k: int = K) -> int:
    """T for a similarity of percent / 100."""
    s = percent / 100
    return max(1, math.floor(k * s - 3.3 * math.sqrt(k * s * (1 - s))))


def signatures(h: np.ndarray, first: np.ndarray, k: int = K) -> np.ndarray:
    """The signature of each row with shingles: the upper halves of the least of k hashes."""
    out = np.empty((len(first) - 1, k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((h ^ _FLIP[i]) * _SPREAD[i], first[:-1]) >> np.uint64(32)
    return out


def shingle_sets(docs: DataFrame, key: str, text: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """SETS of docs: a hash of the text, the set's size, two independent sums of hashes as the set's fingerprint, and the signature (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys = batch.column(0)
            for row, data, starts in blocks(batch.column(2)):
                h, first = distinct(*Words(data, starts).shingles(shingle))
                n = np.diff(first)
                has = np.flatnonzero(n)
                sig = signatures(h, np.append(first[:-1][has], first[-1]), k) if len(has) else np.zeros((0, k), np.uint32)
                fp = np.zeros((2, len(n)), np.uint64)
                if len(has):
                    fp[0, has], fp[1, has] = np.add.reduceat(h, first[:-1][has]), np.add.reduceat(mix(h ^ _FLIP[0]), first[:-1][has])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n > 0))) * k, pa.int32(), mask=np.append(n == 0, False)), pa.array(sig.ravel().view(np.int32)))
                yield pa.record_batch([keys[row : row + len(n)], batch.column(1)[row : row + len(n)], pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists], ["key", "text_hash", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, SETS)


def _prefixes(ws: Workspace, classes: DataFrame, t: int, k: int) -> DataFrame:
    """(pair, rep, n): the prefix of each class that may have a candidate, and how many classes hold the pair."""
    posted = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("pair"))
    held = posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    own = with_group(ws, posted, held, "pair", "n", max(1, classes.count() * k)).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("pairs"))
    own = own.where(F.size("pairs") >= t).withColumn("prefix", F.slice("pairs", 1, F.size("pairs") - t + 1))
    return ws.keep(own.select("rep", F.explode("prefix").alias("p")).select("p.pair", "rep", "p.n"), "prefixes")


def _chunk(many: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.ceil(F.col(many) / CHUNK)).cast("int")


def _linked(ws: Workspace, rows: DataFrame, by: str, compare: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(by, rep, root) over all groups of rows (by, rep): edges whose components are those of all pairs that compare links.

    compare gets (by, x, y, right, rep) and gives (by, rep, root), the least class that each reaches: one task's rows
    have equal by, x and y, and are held against each other, or where x and y differ those with right against those
    without.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("m")).where("m > 1")
    rows = ws.keep(with_group(ws, rows, sizes, by, "m", max(1, rows.count())), f"{name}-groups").withColumn("own", _chunk("m"))
    no = F.lit(False)
    edges = ws.keep(compare(rows.select(by, F.col("own").alias("x"), F.col("own").alias("y"), no.alias("right"), "rep")), name)
    large = rows.where(F.col("m") > CHUNK)
    many = large.count()
    if not many:
        return edges
    # the root of each class in its chunk, then that root's root among the roots of its group
    at = large.join(edges.select(by, "rep", "root").distinct(), [by, "rep"], "left").withColumn("first", F.coalesce("root", "rep")).drop("root")
    at = ws.keep(at, f"{name}-roots")
    pivots = at.select(by, F.col("first").alias("rep")).distinct()
    pivots = with_group(ws, pivots, pivots.groupBy(by).agg(F.count("*").alias("p")), by, "p", many).withColumn("own", _chunk("p"))
    more = ws.keep(compare(pivots.select(by, F.col("own").alias("x"), F.col("own").alias("y"), no.alias("right"), "rep")), name)
    to = more.select(by, F.col("rep").alias("first"), F.col("root").alias("second")).distinct()
    at = ws.keep(at.join(to, [by, "first"], "left").withColumn("root", F.coalesce("second", "first")).drop("first", "second"), f"{name}-roots")
    sums = at.groupBy(by, "root").agg(F.count("*").alias("n")).groupBy(by).agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("m"))
    at = with_group(ws, at.drop("m"), sums, by, "m", many).where("others > 0")
    at = ws.keep(at.withColumn("other", F.col("root") != F.col("main")), f"{name}-others")
    edges = edges.unionByName(more)
    chunks, mine, bounds = F.ceil(F.col("others") / CHUNK).cast("int"), _chunk("others"), F.ceil(F.col("m") / CHUNK).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), many - 1)).alias("to")
    own = at.where("NOT other").select("*", every(chunks)).select(by, F.col("own").alias("x"), (-1 - F.col("to")).alias("y"), no.alias("right"), "rep")
    across = at.where("other").select("*", every(bounds)).select(by, F.col("to").alias("x"), (-1 - mine).alias("y"), F.lit(True).alias("right"), "rep")
    among = at.where("other").withColumn("c", mine).select("*", every(chunks)).select(by, F.least("c", "to").alias("x"), F.greatest("c", "to").alias("y"), (F.col("c") > F.col("to")).alias("right"), "rep")
    last = ws.keep(compare(own.unionByName(across).unionByName(among)), name)
    return edges.unionByName(last)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the bounds of batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        k = np.stack([table.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((np.diff(k) != 0).any(axis=0)) + 1).tolist(), table.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-2])
    if rest is not None and rest.num_rows:
        yield rest


class _Union:
    """Sets of rows; find gives a set's row with the smallest class."""

    def __init__(self, rep: np.ndarray):
        self.rep, self.up = rep, list(range(len(rep)))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            low, high = (i, j) if self.rep[i] <= self.rep[j] else (j, i)
            self.up[high] = low

    def moved(self, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, rep, root) of the rows whose root is another."""
        root = np.array([self.find(i) for i in range(len(self.up))], int)
        at = np.flatnonzero(root != np.arange(len(root)))
        return np.full(len(at), group, np.int64), self.rep[at], self.rep[root[at]]


def _sides(g: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows to hold it against): later rows of one chunk, or of two the rows of the other."""
    n = g.num_rows
    if g.column("x")[0].as_py() == g.column("y")[0].as_py():
        yield from ((i, np.arange(i + 1, n)) for i in range(n - 1))
    else:
        right = g.column("right").to_numpy()
        others = np.flatnonzero(right)
        yield from ((i, others) for i in np.flatnonzero(~right).tolist())


def _signs(g: pa.Table) -> np.ndarray:
    return g.column("sig").chunk(0).flatten().to_numpy().reshape(g.num_rows, -1)


def _collected(found: Iterator[tuple[np.ndarray, ...]], by: str) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for one in found:
        held.append(one)
        if sum(len(x[0]) for x in held) > 20_000:
            yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], [by, "rep", "root"])
            held = []
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], [by, "rep", "root"])


def _tasks(dealt: DataFrame) -> int:
    """Tasks for rows that are compared with each other, by their number: adaptive execution would go by their bytes, which are few."""
    return max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // ROWS))


def _candidate_edges(dealt: DataFrame, sigs: DataFrame, t: int) -> DataFrame:
    """(pair, rep, root): for each list, its classes that reach a smaller one over signatures with t collisions or more."""
    keys = ["pair", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in _groups(batches, keys):
                if g.num_rows > 1:
                    g = g.combine_chunks()
                    sig, sets = _signs(g), _Union(g.column("rep").to_numpy())
                    for i, to in _sides(g):
                        for j in to[(sig[to] == sig[i]).sum(axis=1) >= t].tolist():
                            sets.join(i, j)
                    yield sets.moved(g.column("pair")[0].as_py())

        yield from _collected(found(), "pair")

    rows = dealt.join(sigs, "rep")
    return rows.repartition(_tasks(dealt), *keys).sortWithinPartitions(*keys).select(*keys, "right", "rep", "sig").mapInArrow(run, "pair long, rep long, root long")


def _confirmed_edges(dealt: DataFrame, sigs: DataFrame, texts: DataFrame, t: int, percent: int, shingle: int) -> DataFrame:
    """(component, rep, root): for each group, its classes that reach a smaller one over pairs whose full sets are alike."""
    keys = ["component", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in _groups(batches, keys):
                if g.num_rows < 2:
                    continue
                g = g.combine_chunks()
                sig, sets = _signs(g), _Union(g.column("rep").to_numpy())
                h, first = [], [np.zeros(1, np.int64)]
                for _, data, starts in blocks(g.column("text")):
                    own, at = distinct(*Words(data, starts).shingles(shingle))
                    h.append(own)
                    first.append(at[1:] + first[-1][-1])
                shingles, edge = np.concatenate(h), np.concatenate(first)
                size = np.diff(edge)
                for i, to in _sides(g):
                    to = to[(sig[to] == sig[i]).sum(axis=1) >= t]
                    root = sets.find(i)
                    to = np.array([j for j in to.tolist() if sets.find(j) != root and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])], int)
                    for k in range(0, len(to), 256):
                        part = to[k : k + 256]
                        mine = shingles[edge[i] : edge[i + 1]]
                        rows = np.repeat(np.arange(len(part)), size[part])
                        theirs = shingles[np.repeat(edge[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(len(rows))]
                        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                        both = np.bincount(rows[mine[at] == theirs], minlength=len(part))
                        for j in part[100 * both >= percent * (size[i] + size[part] - both)].tolist():
                            sets.join(i, j)
                yield sets.moved(g.column("component")[0].as_py())

        yield from _collected(found(), "component")

    rows = dealt.join(sigs, "rep").join(texts, "rep")
    return rows.repartition(_tasks(dealt), *keys).sortWithinPartitions(*keys).select(*keys, "right", "rep", "sig", "text").mapInArrow(run, "component long, rep long, root long")


def near_duplicates(ws: Workspace, docs: DataFrame, key: str, text: str, percent: int = 85, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id, fp1, fp2) of each row of docs; component_id is the smallest key that links reach."""
    t = least_agreement(percent, k)
    sets = ws.keep(shingle_sets(docs, key, text, k, shingle), "sets")
    filled = sets.where("key IS NOT NULL AND n_shingles > 0")
    same = ["fp1", "fp2", "n_shingles"]
    # the row with the least key stands for its class; a key can come with texts of several classes
    least = F.min(F.struct("key", "text_hash"))
    classes = filled.groupBy(*same).agg(least.alias("least"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = ws.keep(classes.select(F.xxhash64(*same).alias("rep"), F.col("least.key").alias("least"), F.col("least.text_hash").alias("text_hash"), "n", "sig"), "classes")
    prefixes = _prefixes(ws, classes.select("rep", "sig"), t, k)
    members = prefixes.select("rep").distinct()
    own = classes.join(members, "rep", "left_semi")
    sigs = ws.keep(own.select("rep", "sig"), "signatures")
    # members grow with the input, so the join is the same at every size and never sends them to all tasks
    lone = docs.select(F.col(key).cast("long").alias("least"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    lone = lone.groupBy("least", "text_hash").agg(F.first("text").alias("text"))  # a row that is repeated comes once from each task
    lone = lone.join(own.select("least", "text_hash", "rep").hint("merge"), ["least", "text_hash"])
    texts = ws.keep(lone.groupBy("rep").agg(F.min("text").alias("text")), "texts")

    candidates = _linked(ws, prefixes.select("pair", "rep"), "pair", lambda dealt: _candidate_edges(dealt, sigs, t), "candidates")
    groups = connected_components(ws, candidates, "rep", "root").select("component", F.col("node").alias("rep"))
    links = _linked(ws, groups, "component", lambda dealt: _confirmed_edges(dealt, sigs, texts, t, percent, shingle), "links")
    held = filled.select("key", F.xxhash64(*same).alias("rep"))
    several = held.groupBy("key").agg(F.min("rep").alias("root"), F.max("rep").alias("most"), F.count("*").alias("n")).where("root < most")
    twice = with_group(ws, held, several, "key", "n", max(1, sets.count())).select("rep", "root").distinct()
    labels = connected_components(ws, links.select("rep", "root").unionByName(twice), "rep", "root").select(F.col("node").alias("rep"), "component")
    joined = ws.keep(classes.select("rep", "least").join(labels, "rep"), "joined")
    least_of = joined.groupBy("component").agg(F.min("least").alias("label"), F.count("*").alias("size"))
    named = with_group(ws, joined, least_of, "component", "size", max(1, joined.count())).select("rep", "label")
    named = ws.keep(classes.join(named, "rep", "left").select("rep", "n", F.coalesce("label", "least").alias("component_id")), "named")
    found = with_group(ws, filled.select("key", "n_shingles", "fp1", "fp2", F.xxhash64(*same).alias("rep")), named, "rep", "n", max(1, sets.count()))
    rest = sets.where("key IS NULL OR n_shingles = 0").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("key")))
    out = ["key", "n_shingles", "component_id", "fp1", "fp2"]
    return found.select(*out).unionByName(rest.select(*out))
