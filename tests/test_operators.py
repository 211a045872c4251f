"""Operators against brute force on small random tables, and published golden cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import genotypes as G
from locusframe.operators.segments import segments
from locusframe.operators import allele_join as J
from locusframe.operators import genmap as M
from locusframe.operators import intervals as I
from locusframe.operators import islands as S
from locusframe.operators import ld as L
from locusframe.operators import sim

SPAN = ("chrom", "start", "end")


def regions(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, chrom int, start bigint, end bigint")


def random_regions(rng, n, widest):
    out = []
    for i in range(n):
        s = rng.randrange(1, 200_000)
        out.append((i, rng.randrange(1, 4), s, s + rng.randrange(1, rng.choice([5, 1000, widest]))))
    return out


@pytest.mark.parametrize("levels", [I.LEVELS, (16, 256, 4096, 1 << 30)])
def test_overlap_and_within_against_brute_force(spark, levels):
    rng = random.Random(1)
    q, t = random_regions(rng, 120, 50_000), random_regions(rng, 120, 150_000)
    got = {tuple(r) for r in I.overlap_pairs(regions(spark, q, "q"), "q", SPAN, regions(spark, t, "t"), "t", SPAN, levels=levels).collect()}
    rows = I.overlap_pairs(regions(spark, q, "q"), "q", SPAN, regions(spark, t, "t"), "t", SPAN, levels=levels)
    want = {(a[0], b[0]) for a in q for b in t if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    assert got == want and rows.count() == len(want)
    inside = {tuple(r) for r in I.overlap_pairs(regions(spark, q, "q"), "q", SPAN, regions(spark, t, "t"), "t", SPAN, within=True, levels=levels).collect()}
    assert inside == {(a[0], b[0]) for a in q for b in t if a[1] == b[1] and b[2] <= a[2] and a[3] <= b[3]}


def bounded(rng, n, widest):
    """Regions of which some are copies, empty, without a chromosome or without a bound."""
    rows = random_regions(rng, n, widest)
    return [*rows, *[(i + n, *r[1:]) for i, r in enumerate(rows[:20])], (900, 1, 50, 50), (901, None, 1, 10**6), (902, 1, None, 10), (903, 2, 10, None), (904, 2, 60, 40)]


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("rows", [3, None])
def test_first_match_against_brute_force(spark, within, rows):
    rng = random.Random(31)
    q, t = bounded(rng, 120, 30_000), bounded(rng, 150, 150_000)
    found = I.first_match(regions(spark, q, "q"), "q", SPAN, regions(spark, t, "t"), "t", SPAN, within, rows=rows)
    sound = lambda r: None not in r and r[2] < r[3]
    meets = lambda a, b: b[2] <= a[2] and a[3] <= b[3] if within else a[2] < b[3] and b[2] < a[3]
    want = {a[0]: min((b[0] for b in t if sound(a) and sound(b) and a[1] == b[1] and meets(a, b)), default=None) for a in q}
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    assert "__bin" not in found._jdf.queryExecution().toString()  # no pairs of bins: their number grows with the square of copies
    none = I.first_match(regions(spark, q, "q"), "q", SPAN, regions(spark, t[-5:], "t").where("false"), "t", SPAN, within)
    assert none.where("t IS NULL").count() == len(q)


@pytest.mark.parametrize("rows", [7, None])
def test_flags_and_filters_make_no_pairs(spark, rows):
    rng = random.Random(32)
    q, t = bounded(rng, 120, 3_000), bounded(rng, 60, 9_000)
    a, b = regions(spark, q, "q"), regions(spark, t, "t")
    sound = lambda r: None not in r and r[2] < r[3]
    want = {x[0]: any(sound(x) and sound(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] for y in t) for x in q}
    flags, inside, outside = I.flagged(a, "q", SPAN, b, SPAN, rows=rows), I.overlapping(a, "q", SPAN, b, SPAN, rows=rows), I.overlapping(a, "q", SPAN, b, SPAN, anti=True, rows=rows)
    assert dict(map(tuple, flags.collect())) == want and {True, False} == set(want.values())
    assert sorted(r["q"] for r in inside.collect()) == sorted(k for k, v in want.items() if v) and inside.columns == a.columns
    assert sorted(r["q"] for r in outside.collect()) == sorted(k for k, v in want.items() if not v)
    assert not any("__bin" in df._jdf.queryExecution().toString() for df in (flags, inside, outside))


def test_many_small_rows_of_one_file_are_dealt_before_they_are_summed_up(spark):
    t = regions(spark, [(i, 1, i, i + 9) for i in range(60)], "t").coalesce(1)
    plan = I.first_match(t, "t", SPAN, t.withColumnRenamed("t", "u"), "u", SPAN)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_groups_of_regions_without_an_id_keep_their_pairs(spark):
    t = regions(spark, [(None, 1, 1, 10), (2, 1, 5, 9), (3, 1, 50, 60), (4, None, 1, 9)], "t")
    q = regions(spark, [(7, 1, 6, 7), (8, 1, 1, 2)], "q")
    got = {tuple(r) for r in I.group_by_region(t, "t", SPAN, q, "q", SPAN).collect()}
    assert got == {(None, 7), (None, 8), (2, 7), (3, None), (4, None)}


def test_pairs_are_dealt_to_all_tasks_however_few_their_bytes(spark):
    t = regions(spark, [(i, 1 + i % 5, 1 + i * 300, 900 + i * 300) for i in range(300)], "t").coalesce(1)
    pairs = I.overlap_pairs(t, "t", SPAN, t.withColumnRenamed("t", "u"), "u", SPAN)
    assert sum(n > 0 for n in pairs.rdd.glom().map(len).collect()) == 4


def test_block_boundaries(spark):
    ends = [1, 1892607, 3582736, 4380811, 5913893, 7247335, 9365199]
    blocks = regions(spark, [(i + 1, 1, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))], "block")
    v = spark.createDataFrame([(1, 1, 5913766), (2, 1, 5913893), (3, 1, 5914103), (4, 2, 5), (5, None, 5), (6, 1, None)], "id int, chrom int, pos bigint")
    got = dict(I.first_match(I.with_point_span(v), "id", ("chrom", "pos", "pos_end"), blocks, "block", SPAN).collect())
    assert got == {1: 4, 2: 5, 3: 5, 4: None, 5: None, 6: None}


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    t = [(i, 1 + i % 2, 1000 * i, 1000 * i + rng.randrange(1, 900)) for i in range(1, 60)]
    q = [(i, rng.randrange(1, 4), rng.randrange(1, 70_000)) for i in range(200)]
    df = spark.createDataFrame(q, "id int, chrom int, pos bigint")
    got = {r["id"]: (r["t"], r["distance"]) for r in I.nearest_region(df, "chrom", "pos", regions(spark, t, "t"), "t", SPAN).collect()}
    for i, c, p in q:
        d = [(abs(x), x > 0, x, b[0]) for b in t if b[1] == c for x in [p - b[2] if p < b[2] else 0 if p < b[3] else p - b[3]]]
        assert got[i] == ((min(d)[3], min(d)[2]) if d else (None, None))


@pytest.mark.parametrize("rows", [10, None])
def test_nearest_of_overlapping_targets_against_brute_force(spark, rows):
    rng = random.Random(12)
    t = [(1, 1, 100, 1000), (2, 1, 200, 210), (3, 1, 5000, 5001), (4, 1, 300, 300), (5, 1, None, 900), (6, 1, 700, None), (7, None, 1, 10**6)]
    for i in range(10, 150):
        start = rng.randrange(1, 40_000)
        t.append((i, rng.randrange(1, 4), start, start + rng.choice([1, 30, 600, 9000])))
    t += [(200, 2, 50_000, 50_400), (201, 2, 50_100, 50_400), (202, 2, 50_100, 50_400), (203, 2, 61_000, 62_000), (204, 2, 61_000, 61_500)]
    q = [(0, 1, 500), (1, 1, 1500), (2, 2, 50_300), (3, 2, 60_000), (4, 9, 5), (5, None, 5), (6, 1, None)] + [(i, rng.randrange(1, 4), rng.randrange(1, 70_000)) for i in range(10, 300)]
    df = spark.createDataFrame(q, "id int, chrom int, pos bigint")
    got = {r["id"]: (r["t"], r["distance"]) for r in I.nearest_region(df, "chrom", "pos", regions(spark, t, "t"), "t", SPAN, rows=rows).collect()}
    assert len(got) == len(q) and got[0] == (1, 0)
    for i, c, p in q:
        near = []
        for b in t:
            if c is not None and p is not None and b[1] == c and None not in b and b[2] < b[3]:
                if p < b[2]:
                    near.append((b[2] - p, 0, b[2], b[3], b[0], p - b[2]))
                else:
                    near.append((max(0, p - b[3]), 1 if p >= b[3] else -1, -b[3], -b[2], -b[0], max(0, p - b[3])))
        assert got[i] == ((abs(min(near)[4]), min(near)[5]) if near else (None, None)), (i, c, p)


def test_segments_are_even_where_rows_are_dense(spark):
    """90 % of the rows lie in one megabase of 200."""
    n = 40_000
    v = spark.range(n).selectExpr("id", "CAST(1 + id % 2 AS INT) AS chrom", "CASE WHEN id % 10 < 9 THEN 150000000 + (id * 7919) % 1000000 ELSE (id * 104729) % 200000000 END AS pos")
    cut = segments(v, "chrom", "pos", rows=1000)
    held = [r["count"] for r in cut.number(v, "chrom", "pos").groupBy("chrom", "__seg").count().collect()]
    assert sum(held) == n and len(held) >= 36 and max(held) <= 2 * sum(held) / len(held)
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(v.collect(), key=lambda r: (r["chrom"], r["pos"], r["id"])))}
    assert {r["id"]: r["rank"] for r in S.ranked(v, ["chrom", "pos", "id"], rows=1000).collect()} == want
    t = v.where("id % 50 = 0").selectExpr("id AS t", "chrom", "pos AS start", "pos + 300 + id % 900 AS end")
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(S.merged(t, ties=["t"], rows=50), "chrom", "start", "end", "members") == key(S.merged(t, ties=["t"]), "chrom", "start", "end", "members")
    one, many = (I.nearest_region(v, "chrom", "pos", t, "t", SPAN, rows=r) for r in (None, 500))
    assert key(one, "id", "t", "distance") == key(many, "id", "t", "distance")
    cm = v.selectExpr("id", "chrom", "pos", "pos / 1e6D AS cm").where("id % 4 < 2")
    assert key(M.windows(cm, 0.01, rows=400), "id", "start", "end") == key(M.windows(cm, 0.01), "id", "start", "end")


def test_rows_at_one_position_stay_together(spark):
    v = spark.range(5000).selectExpr("id", "1 AS chrom", "CASE WHEN id < 4000 THEN 77L ELSE id END AS pos")
    cut = segments(v, "chrom", "pos", rows=100)
    assert cut.number(v, "chrom", "pos").where("pos = 77").select("__seg").distinct().count() == 1
    assert S.ranked(v, ["chrom", "pos", "id"], rows=100).where("rank <> id + 1").isEmpty()


def test_as_of_crosses_segments(spark):
    t = spark.createDataFrame([(1, 10, 1.0), (1, 5000, 2.0), (2, 7, 3.0)], "chrom int, pos bigint, v double")
    q = spark.createDataFrame([(1, 9), (1, 10), (1, 4999), (1, 5000), (1, 90000), (2, 100), (3, 1)], "chrom int, pos bigint")
    got = {(r["chrom"], r["pos"]): (r["prev"] and r["prev"]["v"], r["next"] and r["next"]["v"]) for r in I.as_of(q, "chrom", "pos", t, "chrom", "pos", F.struct("pos", "v"), rows=7).collect()}
    assert got == {(1, 9): (None, 1.0), (1, 10): (1.0, 2.0), (1, 4999): (1.0, 2.0), (1, 5000): (2.0, None), (1, 90000): (2.0, None), (2, 100): (3.0, None), (3, 1): (None, None)}


def test_interpolation_goldens(spark):
    k = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 30, 1.0)], "chrom int, pos bigint, cm double")
    q = spark.createDataFrame([(1, p) for p in (15, 16, 9, 20, 21, 22, 25, 26)] + [(2, 30), (2, 31), (3, 5)], "chrom int, pos bigint")
    got = {(r["chrom"], r["pos"]): r["map"] for r in M.interpolate(q, k).collect()}
    want = {(1, 15): 1.5, (1, 16): 1.6, (1, 9): 0.9, (1, 20): 2.0, (1, 21): 2.1, (1, 22): 2.2, (1, 25): 2.5, (1, 26): 2.6, (2, 30): 1.0, (2, 31): None, (3, 5): None}
    assert {x: y if y is None else round(y, 9) for x, y in got.items()} == want
    with pytest.raises(Exception, match="outside the map"):
        M.interpolate(q, k, strict=True).collect()


def test_interpolation_beyond_end_knots_that_share_a_position(spark):
    k = spark.createDataFrame([(1, 10, 1.0), (1, 10, 1.0), (1, 20, 2.0), (1, 30, 3.0), (1, 30, 3.0), (2, 5, 1.0), (2, 5, 2.0)], "chrom int, pos bigint, cm double")
    q = spark.createDataFrame([(1, p) for p in (5, 10, 15, 30, 40)] + [(2, 6)], "chrom int, pos bigint")
    got = {(r["chrom"], r["pos"]): r["map"] for r in M.interpolate(q, k).collect()}
    assert math.isnan(got.pop((1, 5))) and math.isnan(got.pop((1, 40))) and math.isinf(got.pop((2, 6)))
    assert got == {(1, 10): 1.0, (1, 15): 1.5, (1, 30): 3.0}


def test_clusters_and_disjoin_against_brute_force(spark):
    rng = random.Random(3)
    t = random_regions(rng, 150, 20_000)
    df = regions(spark, t, "t")
    for rows in (7, 1 << 22):
        cover = {}
        for _, c, s, e in t:
            cover.setdefault(c, []).append((s, e))
        got = sorted(tuple(r) for r in S.disjoin(df, rows=rows).select("chrom", "start", "end", "depth").collect())
        want = []
        for c, xs in cover.items():
            cuts = sorted({x for s in xs for x in s})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                depth = sum(s <= a and b <= e for s, e in xs)
                if depth:
                    want.append((c, a, b, depth))
        assert got == sorted(want)
        merged = sorted(tuple(r) for r in S.merged(df, ties=["t"], rows=rows).select("chrom", "start", "end", "members").collect())
        want = []
        for c, xs in cover.items():
            now = None
            for s, e in sorted(xs):
                if now and s < now[2]:
                    now = (c, now[1], max(now[2], e), now[3] + 1)
                else:
                    want += [now] if now else []
                    now = (c, s, e, 1)
            want.append(now)
        assert merged == sorted(want)


def test_nested_regions_end_a_cluster_only_in_compat(spark):
    df = regions(spark, [(1, 1, 1, 100), (2, 1, 2, 10), (3, 1, 50, 60)], "t")
    ids = lambda **k: [r[0] for r in S.clusters(df, **k).orderBy("t").select("cluster").collect()]
    assert ids() == [1, 1, 1] and ids(compat=True) == [1, 1, 2]


def test_touching_regions_stay_apart_and_overlaps_are_refused(spark):
    df = regions(spark, [(1, 1, 1, 10), (2, 1, 10, 20), (3, 2, 1, 5)], "t")
    assert [r[0] for r in S.clusters(df).orderBy("t").select("cluster").collect()] == [1, 2, 1]
    with pytest.raises(Exception, match="regions overlap"):
        S.union_disjoint(df, regions(spark, [(4, 1, 5, 7)], "t"), strict=True).collect()
    with pytest.raises(Exception, match="several chromosomes"):
        S.hull(df).collect()


def test_best_match_takes_lowest_code_then_id(spark):
    q = spark.createDataFrame([(1, 1, 5, 1, 2), (2, 1, 6, 1, 2), (3, 1, 7, 1, 2)], "q int, chrom int, pos bigint, ref int, alt int")
    t = spark.createDataFrame([(9, 1, 5, 2, 1), (8, 1, 5, 1, 2), (7, 1, 5, 1, 2), (6, 1, 6, 1, 1)], "t int, chrom int, pos bigint, ref int, alt int")
    got = {r["q"]: (r["match_code"], r["t"]) for r in J.best_match(q, "q", t, "t").collect()}
    assert got == {1: (1, 7), 2: (None, None), 3: (None, None)}
    g = J.harmonise(q.withColumn("beta", F.lit(2.0)), "q", t.where("t = 9"), "t")
    assert [(r["q"], r["beta"]) for r in g.collect()] == [(1, -2.0)]


def test_missing_ids_are_refused(spark):
    df = spark.createDataFrame([(1,), (2,)], "rsid bigint")
    assert J.by_id_complete(df, df.where("rsid = 1"), "rsid").count() == 1
    with pytest.raises(Exception, match="not found: 3"):
        J.by_id_complete(df, spark.createDataFrame([(3,)], "rsid bigint"), "rsid").collect()


def test_covariance_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (6, 70))
    df = spark.createDataFrame([(0, i, [int(v) for v in r], i * 0.01) for i, r in enumerate(x)], "block int, id bigint, bits array<int>, cm double").withColumn("words", G.pack_bits("bits"))
    cov, cor = np.cov(x), np.corrcoef(x)
    for r in L.pair_covariance(df, "block", "id", "words", 70).collect():
        assert abs(r["cov"] - cov[r["i"], r["j"]]) < 1e-12 and abs(r["cor"] - cor[r["i"], r["j"]]) < 1e-12
    dense = {(r["i"], r["j"]): r["cor"] for r in L.dense(df, "block", "id", "bits").collect()}
    assert len(dense) == 21 and all(abs(v - cor[k]) < 1e-12 for k, v in dense.items())
    s = sum(1 / i for i in range(1, 2 * L.M))
    t = (1 / s) / (2 * L.M + 1 / s)
    d = np.abs(np.subtract.outer(np.arange(6) * 0.01, np.arange(6) * 0.01))
    rho = np.exp(-4 * L.NE * d / 100 / (2 * L.M))
    rho[rho < L.CUTOFF] = 0
    m = cov * rho * (1 - t) ** 2 + np.eye(6) * t / 2 * (1 - t / 2)
    m = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
    ld = L.shrunk(df, "block", "id", "words", "cm", 70)
    assert all(abs(r["r"] - m[r["i"], r["j"]]) < 1e-12 for r in ld.collect())
    want = (m**2 - (1 - m**2) / 68).sum(axis=1)
    assert all(abs(r["score"] - want[r["i"]]) < 1e-9 for r in L.scores(ld, "block", 70).collect())


def test_windows_and_maps(spark):
    k = spark.createDataFrame([(1, 10, 0.0), (1, 20, 0.2), (1, 30, 0.5), (1, 40, 0.5), (2, 5, 0.0)], "chrom int, pos bigint, cm double")
    got = {(r["chrom"], r["pos"]): (r["start"], r["end"]) for r in M.windows(k, 0.6).collect()}
    assert got == {(1, 10): (10, 21), (1, 20): (10, 41), (1, 30): (20, 41), (1, 40): (20, 41), (2, 5): (5, 6)}
    assert [r["pos"] for r in M.not_increasing(k).collect()] == [40]
    assert M.not_increasing(M.jittered_until_increasing(k, 1e-6)).isEmpty()
    with pytest.raises(Exception, match="does not increase"):
        M.checked(k).collect()


def test_feature_sets(spark):
    v = I.with_point_span(spark.createDataFrame([(1, 1, 5), (2, 1, 50), (3, 1, 500)], "id int, chrom int, pos bigint"))
    f = spark.createDataFrame([("a", 1, 1, 10), ("b", 1, 5, 6), ("a", 1, 40, 60)], "feature string, chrom int, start bigint, end bigint")
    got = sorted(tuple(r) for r in I.annotate_sets(v, "id", ("chrom", "pos", "pos_end"), f, "feature", SPAN, ["a", "b"]).collect())
    assert got == [(1, 1, 1), (2, 1, 0)]


def test_simulation_is_repeatable_and_in_bounds(spark):
    sizes = spark.createDataFrame([(1, 1000), (2, 50)], "chrom int, size bigint")
    a, b = (sorted(tuple(r) for r in sim.random_regions(spark, 300, sizes, 5).collect()) for _ in range(2))
    assert a == b and len(a) == 300 and all(1 <= s < e <= (1001 if c == 1 else 51) for _, c, s, e in a)
    r = regions(spark, [(1, 1, 10, 13), (2, 1, 100, 200)], "t")
    got = [tuple(x) for x in sim.sample_in_regions(r, "t", 5, 1, replace=False).collect()]
    assert sorted(p for i, _, p in got if i == 1) == [10, 11, 12] and len({p for i, _, p in got if i == 2}) == 5


def test_missing_chromosomes_are_a_group_and_lose_no_row(spark):
    df = regions(spark, [(1, 1, 1, 10), (2, None, 5, 20), (3, None, 15, 30), (4, 1, 5, None), (5, 1, None, 7)], "t")
    assert S.clusters(df).count() == 5 and S.hull_over(df).count() == 5 and S.cluster_hulls(df).count() == 5
    got = {r["t"]: r["cluster"] for r in S.clusters(df).collect()}
    assert got[2] == got[3] == 1
    assert {r["t"]: (r["hull_start"], r["hull_end"]) for r in S.hull_over(df).where("chrom IS NULL").collect()} == {2: (5, 30), 3: (5, 30)}


def test_tiles_and_bands_make_every_pair_once(spark):
    rng = random.Random(21)
    rows = [(i, rng.choice([1, 1, 2, None]), rng.choice([None, rng.uniform(0, 6)]) if i % 9 == 0 else rng.uniform(0, 6)) for i in range(160)]
    df = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], "id bigint, block int, cm double, v int")
    for tile in (5, 1000):
        got = sorted(tuple(r) for r in L.pairs(df, "block", "id", ["v"], tile=tile).select("block", "i", "j").collect())
        assert got == sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] is not None and a[0] <= b[0])
        near = sorted(tuple(r) for r in L.pairs(df, "block", "id", ["v"], "cm", 0.7, tile).select("block", "i", "j").collect())
        want = [(a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] is not None and a[0] <= b[0] and (a[0] == b[0] or None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 0.7)]
        assert near == sorted(want)
    assert L.pairs(df.limit(0), "block", "id", ["v"], "cm", 0.7).count() == 0


def test_all_pairs_of_a_block_come_from_tiles_and_not_from_a_join(spark):
    """One row a pair before the values are known took some 50 microseconds a pair."""
    words = [[5], [-1], [0], None, [7, 1], [None], [-(2**63)]]
    df = spark.createDataFrame([(1, i, w, 0.1 * i) for i, w in enumerate(words)] + [(None, 90, [1], 0.0), (2, 91, [3], 0.0), (2, None, [3], 0.0)], "block int, id long, words array<bigint>, cm double")
    for tile in (2, 512):
        out = L.pair_covariance(df, "block", "id", "words", 70, tile=tile)
        got = {(r["i"], r["j"]): (r["cov"], r["cor"]) for r in out.collect()}
        assert sorted(got) == sorted([(i, j) for i in range(7) for j in range(i, 7)] + [(91, 91)])
        bits = {i: None if w is None or None in w else [x >> k & 1 for x in w for k in range(64)] for i, w in enumerate(words)}
        for (i, j), (cov, cor) in got.items():
            a, b = bits.get(i, [1, 1]), bits.get(j, [1, 1])
            if a is None or b is None or len(a) != len(b):
                assert cov is None and cor == (1.0 if i == j else None)
                continue
            of = lambda x, y: (70 * sum(p * q for p, q in zip(x, y)) - sum(x) * sum(y)) / (70 * 69)
            assert abs(cov - of(a, b)) < 1e-12
            var = of(a, a) * of(b, b)
            assert cor == 1.0 if i == j else cor is None if not var else abs(cor - of(a, b) / var**0.5) < 1e-12
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "FlatMapGroupsInArrow" in plan and "REPARTITION_BY_NUM" in plan and plan.count("Join") == 1  # with the numbers of tiles


def test_a_variant_is_sent_to_as_many_tasks_whatever_its_block(spark):
    """It was sent to a task for each tile of its block, so what is shuffled grew with the square of the block."""
    for n, tile, tasks in ((600, 1, 19), (200, 4, 16), (20, 2, 10)):  # 19: parts hold 32 tiles at most
        ids = [i // 2 if i < 60 else i for i in range(n)]  # some keys come twice, also across the tiles of a part
        df = spark.createDataFrame([(i, [i * 977]) for i in ids], "id bigint, words array<bigint>").selectExpr("1 AS block", "*")
        out = L.pair_covariance(df, "block", "id", "words", 64, correlation=False, tile=tile)
        dealt = out._jdf.queryExecution().analyzed().child()
        assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, dealt).count() == n * tasks
        if tile > 1:
            assert sorted((r["i"], r["j"]) for r in out.select("i", "j").collect()) == sorted((a, b) for a in ids for b in ids if a <= b)


def test_panel_correlations_of_missing_dosages(spark):
    rows = [(1, 0, [0, 1, 2, None]), (1, 1, [2, None, 0, 1]), (1, 2, [1, 1, 1, 1]), (1, 3, [None, None, None, 2]), (1, 4, [0, 2, 2, 1]), (2, 5, [0, 1, 2, 0])]
    df = spark.createDataFrame(rows, "chrom int, id long, dosages array<int>")
    read = lambda ref, *at: df.select("id", "dosages") if at else df.selectExpr("chrom", "id", "id AS pos", "0.0D AS cm")
    for tile in (2, 512):
        got = {(r["i"], r["j"]): r["r"] for r in L.panel_ld("", read, read, shrink=False, digits=6, tile=tile).collect()}
        want = {}
        for i in range(6):
            for j in range(i, 6 if i == 5 else 5):
                x, y = rows[i][2], rows[j][2]
                of = lambda x, y: (lambda p: (len(p) * sum(a * b for a, b in p) - sum(a for a, _ in p) * sum(b for _, b in p)) / (len(p) * (len(p) - 1)) if len(p) > 1 else None)([(a, b) for a, b in zip(x, y) if a is not None and b is not None])
                c, v, w = of(x, y), of(x, x), of(y, y)
                want[i, j] = 1.0 if i == j else None if c is None or not v or not w else round(c / (v * w) ** 0.5, 6)
        assert got == want


def test_rounding_is_sparks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=2000), rng.integers(-(10**7), 10**7, 3000) / 2e6, [0.0000005, -0.0000015, 2.5e-7, 0.0, -0.0, -1e-9, 1.0049999999999999, 123456789.1234565, 1e12 + 0.5, 1e300, 1 / 3]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", F.round("x", 6).alias("r")).collect()
    mine = L.rounded(np.array([r["x"] for r in got]), 6)
    assert all(a == r["r"] and np.signbit(a) == np.signbit(r["r"]) for a, r in zip(mine.tolist(), got))


def test_a_large_block_is_dealt_to_many_tasks(spark):
    """20,000 variants of one block; none of the pairs that are too far apart is made."""
    h = spark.range(20_000).selectExpr("id", "1 AS block", "id * 0.05D AS cm", "array(xxhash64(id), xxhash64(id, 1)) AS words")
    out = L.shrunk(h, "block", "id", "words", "cm", 128)
    per_task = [r["count"] for r in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    reach = int(L.reach(L.M, L.NE, L.CUTOFF) / 0.05)
    assert sum(per_task) == sum(min(reach, 19_999 - i) + 1 for i in range(20_000)) and len(per_task) == 4
    tiles = L._tiled(h.select("block", "id"), "block", "id", None, None, L.TILE)
    assert max(r["count"] for r in tiles.groupBy("__tile").count().collect()) < 1.3 * L.TILE


def test_covariance_of_planes_is_that_of_dosages(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0, 1, 2, None]) if i % 3 else rng.choice([0, 1, 2]) for _ in range(n)], [rng.choice([0, 1, 2, None]) for _ in range(n)]) for i, n in enumerate([1, 2, 63, 64, 65, 130, 200, 0])]
    rows += [(90, [None, None, 1], [1, 2, None]), (91, [1, 2], [0, 1, 2, 2]), (92, [1, 1, 1], [0, 1, 2])]
    df = spark.createDataFrame(rows, "id int, x array<int>, y array<int>").withColumns({"p": G.planes("x"), "q": G.planes("y")})
    for r in df.select("id", G.dosage_covariance("x", "y").alias("want"), G.plane_covariance("p", "q").alias("got"), G.plane_covariance("p", "p").alias("var")).collect():
        assert (r["got"] is None) == (r["want"] is None) and (r["got"] is None or abs(r["got"] - r["want"]) < 1e-12)
    for i, x, y in rows:
        both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
        got = df.where(F.col("id") == i).select(G.plane_covariance("p", "q")).first()[0]
        assert got is None if len(both) < 2 else abs(got - np.cov(np.array(both).T)[0, 1]) < 1e-9


def test_rank_over_segments(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.randrange(1, 3000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "t bigint, chrom int, pos bigint")
    low = lambda x: (x is not None, x or 0)
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (low(r[1]), low(r[2]), r[0])))}
    for n in (20, 1 << 22):
        assert {r["t"]: r["rank"] for r in S.ranked(df, ["chrom", "pos", "t"], rows=n).collect()} == want


def test_wide_regions_give_few_rows_on_either_side(spark):
    wide = regions(spark, [(1, 1, 1, 248_000_000), (2, 1, 5, 9), (3, 1, 100_000_000, 100_300_000)], "q")
    fine = regions(spark, [(i, 1, i * 1_000_000 + 1, i * 1_000_000 + 200) for i in range(240)], "t")
    for a, b in ((wide, fine), (fine, wide)):
        (x, y), both = (c.columns[0] for c in (a, b)), [c.select(F.col(c.columns[0]).alias("id"), F.col("chrom").alias("__chrom"), F.col("start").alias("s"), F.col("end").alias("e")) for c in (a, b)]
        q, t = both[0].select("id", "__chrom", F.col("s").alias("__qs"), F.col("e").alias("__qe")), both[1].select("id", "__chrom", F.col("s").alias("__ts"), F.col("e").alias("__te"))
        ql, tl = I.binned_pair(q, t, I.used_levels(q, "__qs", "__qe"), I.used_levels(t, "__ts", "__te"))
        assert ql.count() + tl.count() <= 2 * (len(I.LEVELS) + 1) * (q.count() + t.count())
        assert I.overlap_pairs(a, x, SPAN, b, y, SPAN).count() == 240 + 2


def test_sampling_without_replacement_is_uniform(spark):
    r = spark.range(4000).select(F.col("id").alias("t"), F.lit(1).alias("chrom"), F.lit(10).alias("start"), F.lit(15).alias("end"))
    rows = sim.sample_in_regions(r, "t", 2, 1, replace=False).groupBy("t").agg(F.sort_array(F.collect_list("pos")).alias("p")).groupBy("p").count().collect()
    assert len(rows) == 10 and all(320 <= x["count"] <= 480 for x in rows)


def test_windows_cut_on_the_map_equal_whole_ones(spark):
    rng = random.Random(8)
    rows = [(c, i * 10, i * 0.07 + rng.random() * 0.05) for c in (1, 2) for i in range(80)] + [(1, 5000, None)]
    got = {(r["chrom"], r["pos"]): (r["start"], r["end"]) for r in M.windows(spark.createDataFrame(rows, "chrom int, pos bigint, cm double"), 0.6).collect()}
    for c, p, m in rows:
        near = [q for d, q, k in rows if m is not None and d == c and k is not None and abs(k - m) <= 0.3]
        assert got[c, p] == ((min(near), max(near) + 1) if near else (None, None))


def test_casts_and_types(spark):
    from locusframe.operators import columns as K

    df = spark.createDataFrame([("chr1:5_A_C", "chr2:1_9"), ("x", "y"), (None, None)], "v string, r string")
    out = df.withColumns({"a": K.as_variant(df, "v"), "b": K.as_region(df, "r")})
    assert K.is_variant(out, "a") and K.is_region(out, "b") and not K.is_variant(out, "b")
    assert [tuple(x) if x else None for x in (r["a"] for r in out.collect())] == [(1, 5, 1, 2), None, None]
    assert [r["x"] and tuple(r["x"]) for r in out.select(K.as_region(out, "a").alias("x")).collect()] == [(1, 5, 6), None, None]


def test_texts_with_bases_that_a_variant_cannot_have(spark):
    from locusframe.functions import coords as C

    df = spark.createDataFrame([("1:5_A_U",), ("1:5_U_A",), ("1:5_A_T",)], "t string")
    assert [r["pos"] for r in df.select(C.parse_variant("t")["pos"].alias("pos")).collect()] == [None, None, 5]
