"""Near duplicates among embeddings: sign hashing in several tables, exact cosines, connected components.

Equal vectors form a class, known by a 64-bit hash of its bytes. Each table cuts space by random hyperplanes; classes
on the same side of all of them share a bucket. What is shuffled for a table is a class's bucket, its number and a
sketch, the signs of SKETCH more hyperplanes; classes of a bucket whose sketches differ in few enough places are
candidates. Only classes with a candidate have their vectors looked up: each group of candidates of a bucket gets them
once, however many tables found the same group, and cosines are computed there in double precision. Links give the
components, and within each component all links are counted, again by exact cosines.

Two vectors at the threshold share a table's bucket with probability (1 - angle / pi) ** bits, and there are as many
tables as it takes to miss such a pair with probability MISS, whatever the number of classes; sketches miss it with
about MISS / 2 more. bits follow the number of classes, so buckets stay at about BUCKET classes where vectors are
spread; buckets and components of more than CHUNK classes are cut into chunks whose pairs are dealt over tasks, and
nothing is capped. Pairs are never rows.

Vectors that are null, hold nulls, NaN or infinities, or have length 0 link with nothing; so do rows with null
ids, and vectors of different dimension. Repeated rows link with each other. Empty tables give no rows.
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
from .texts import mix

MISS = 1e-4
BUCKET, CHUNK = 512, 2048
SKETCH = 128
SEED = 5


def plan(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n classes and a cosine of at least `least`."""
    bits = min(40, max(4, round(math.log2(max(n, 2) / BUCKET))))
    p = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-p))


def most_apart(least: float, miss: float = MISS / 2) -> int:
    """The least number of places that sketches may differ in so that a pair at the threshold is missed with probability miss at most."""
    p, below = math.acos(least) / math.pi, 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if 1 - below <= miss:
            return k
    return SKETCH


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, SKETCH + bits * tables))


def codes(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each row in each table, and its sketch in two words."""
    sides = (x @ _planes(x.shape[1], bits, tables)) > 0
    sketch = np.packbits(sides[:, :SKETCH], axis=1).view(np.int64)
    return sides[:, SKETCH:].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)), sketch


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(keys: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, classes) of the rows that can link, by dimension."""
    import xxhash

    present = lists.is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    size = np.where(present, np.diff(offsets), 0)
    data = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    if data.dtype not in (np.float32, np.float64):
        data = data.astype(np.float64)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = data[offsets[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
        rows, x = rows[fine], np.ascontiguousarray(x[fine])
        if len(rows):
            yield rows, x, np.fromiter((xxhash.xxh3_64_intdigest(v.tobytes(), dim) for v in x), np.uint64, len(x)).view(np.int64)


def _each(table: DataFrame, key: str, vector: str, schema: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """What make gives for (vectors, classes) of one dimension, equal vectors of a batch once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                for _, x, cid in valid(part.column(0), part.column(1).slice(0)):
                    cid, first = np.unique(cid, return_index=True)
                    yield pa.record_batch(make(x[first], cid), names)

    return table.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(run, schema)


def _classes_of_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, cid) of every row; cid is null where the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for rows, _, cid in valid(batch.column(0), batch.column(1)):
                out[rows], some[rows] = cid, True
            yield pa.record_batch([batch.column(0), pa.array(out, mask=~some)], ["key", "cid"])

    return table.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInArrow(run, "key long, cid long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the bounds of batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        if rest and any(rest[-1].column(c)[-1].as_py() != v for c, v in zip(keys, k[:, 0].tolist(), strict=True)):
            yield pa.Table.from_batches(rest)
            rest = []
        edges = [0, *(np.flatnonzero((np.diff(k) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _dealt(rows: DataFrame, chunks: Column) -> DataFrame:
    """rows with chunks x <= y of their group, once for each other chunk; right marks rows of y."""
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod("cid", F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "right": F.col("own") > F.col("other")}).drop("own", "other", "chunks")


def _reach(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over a symmetric matrix of links."""
    now = np.arange(len(links))
    while True:
        after = np.minimum(now, np.where(links, now[None, :], len(links)).min(axis=1))
        after = after[after]
        if (after == now).all():
            return now
        now = after


def _batched(found: Iterator[list[np.ndarray]], names: list[str], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    for arrays in found:
        held.append(arrays)
        if sum(len(x[0]) for x in held) > most:
            yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names)


def candidates(rows: DataFrame, apart: int) -> DataFrame:
    """(comp, cid): the groups of classes that sketches link in each bucket, equal groups of several buckets once."""
    keys = ["code", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for g in _groups(batches, keys):
                if g.num_rows < 2:
                    continue
                cid, first = np.unique(g.column("cid").to_numpy(), return_index=True)
                s1, s2 = (g.column(c).to_numpy()[first].view(np.uint64) for c in ("s1", "s2"))
                right = g.column("right").to_numpy()[first]
                near = np.bitwise_count(s1[:, None] ^ s1[None, :]) + np.bitwise_count(s2[:, None] ^ s2[None, :]) <= apart
                np.fill_diagonal(near, False)
                if g.column("x")[0].as_py() != g.column("y")[0].as_py():
                    near &= right[:, None] != right[None, :]
                some = np.flatnonzero(near.any(axis=1))
                if not len(some):
                    continue
                root, cid = _reach(near[np.ix_(some, some)]), cid[some]
                sums = np.zeros(len(cid), np.uint64)
                np.add.at(sums, root, mix(cid.view(np.uint64)))
                yield [mix(sums)[root].view(np.int64), cid]

        yield from _batched(found(), ["comp", "cid"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "right", "cid", "s1", "s2").mapInArrow(run, "comp long, cid long").distinct()


def _vectors(g: pa.Table, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(g.column("vec").to_pylist()), kind).reshape(g.num_rows, -1))


def confirmed(members: DataFrame, least: float, kind: str) -> DataFrame:
    """(cid, root): what each class of a group of candidates reaches over cosines of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for g in _groups(batches, ["comp"]):
                x, cid = _vectors(g, kind), g.column("cid").to_numpy()
                root = _reach(x @ x.T >= least)
                some = root != np.arange(len(root))
                yield [cid[some], cid[root[some]]]

        yield from _batched(found(), ["cid", "root"])

    return members.repartition("comp").sortWithinPartitions("comp").select("comp", "cid", "vec").mapInArrow(run, "cid long, root long").distinct()


def counted(rows: DataFrame, least: float, kind: str) -> DataFrame:
    """(cid, links): rows of the table whose vectors link with each class's, its own class left out."""
    keys = ["component", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for g in _groups(batches, keys):
                x, n, right = _vectors(g, kind), g.column("n").to_numpy(), g.column("right").to_numpy()
                links = x @ x.T >= least
                np.fill_diagonal(links, False)
                if g.column("x")[0].as_py() != g.column("y")[0].as_py():
                    links &= right[:, None] != right[None, :]
                yield [g.column("cid").to_numpy(), links @ n]

        yield from _batched(found(), ["cid", "links"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "right", "cid", "n", "vec").mapInArrow(run, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(ws: Workspace, table: DataFrame, key: str, vector: str, least: float = 0.95) -> DataFrame:
    """(key, n_links, component_id) of each row: other rows with a cosine of at least `least`, and the smallest key that links reach."""
    kind = "<f4" if dict(table.dtypes)[vector] == "array<float>" else "<f8"
    table = table if kind == "<f4" else table.withColumn(vector, F.col(vector).cast("array<double>"))
    rows = ws.keep(_classes_of_rows(table, key, vector), "rows")
    classes = ws.keep(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("key").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.count()
    bits, tables = plan(total, least)
    number = lambda x: (np.int64(x.shape[1] * tables) + np.arange(tables)) << bits

    def count(x: np.ndarray, cid: np.ndarray) -> list[pa.Array]:
        return [pa.array(a) for a in np.unique(codes(x, bits, tables)[0] + number(x), return_counts=True)]

    def post(x: np.ndarray, cid: np.ndarray) -> list[pa.Array]:
        code, sketch = codes(x, bits, tables)
        return [pa.array((code + number(x)).ravel()), pa.array(np.repeat(cid, tables)), *[pa.array(np.repeat(s, tables)) for s in sketch.T]]

    held = _each(table, key, vector, "code long, m long", count).groupBy("code").agg(F.sum("m").alias("m")).where(F.col("m") > CHUNK)
    long_ones = ws.keep(held.select("code", F.ceil(F.col("m") / CHUNK).cast("int").alias("many")), "buckets")
    if long_ones.count() <= 100_000:  # else Spark's own join
        long_ones = F.broadcast(long_ones)
    posted = _each(table, key, vector, "code long, cid long, s1 long, s2 long", post).join(long_ones, "code", "left")
    members = ws.keep(candidates(_dealt(posted, F.coalesce("many", F.lit(1))), most_apart(least)), "members")
    looked_up = _each(table, key, vector, "cid long, vec binary", lambda x, cid: [pa.array(cid), pa.array([v.tobytes() for v in x], pa.binary())])
    vectors = ws.keep(looked_up.join(members.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"]), "vectors")
    found = ws.keep(confirmed(members.join(vectors, "cid"), least, kind), "found")
    named = ws.keep(connected_components(ws, found, "cid", "root").select(F.col("node").alias("cid"), "component"), "components")
    named = named.join(classes, "cid")
    sizes = named.groupBy("component").agg(F.count("*").alias("m"), F.min("least").alias("label"))
    grouped = ws.keep(with_group(ws, named, sizes, "component", "m", max(1, named.count())), "grouped")
    links = counted(_dealt(grouped.select("component", "cid", "n", "m").join(vectors, "cid"), F.ceil(F.col("m") / CHUNK).cast("int")), least, kind)
    of = ws.keep(classes.join(grouped.select("cid", "label"), "cid", "left").join(links, "cid", "left"), "links")
    of = of.select("cid", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "least").alias("label"))
    known = with_group(ws, rows.where("cid IS NOT NULL"), of, "cid", "n", max(1, rows.count()))
    known = known.select("key", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), F.col("label").alias("component_id"))
    return known.unionByName(rows.where("cid IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
