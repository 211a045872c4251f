"""Published golden values and round trips of column expressions."""

from pyspark.sql import functions as F

from locusframe.functions import alleles as A
from locusframe.functions import coords as C
from locusframe.functions import genotypes as G


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_allele_unions(spark):
    a, c, g, t = (A.mask_of(F.lit(x)) for x in "ACGT")
    ac = A.union(a, c)
    got = one(spark, A.letter_of(A.union(A.union(ac, t), g)), A.letter_of(A.union(t, t)), A.letter_of(A.other(a, A.union(a, t))), A.mask_of(F.lit("n")), A.mask_of(F.lit("?")), A.mask_of(F.lit("U")))
    assert got == ["N", "T", "T", 15, None, 8]


def test_match_counts_over_all_sets(spark):
    n = spark.range(15**4).select(*[(F.floor(F.col("id") / 15**i) % 15 + 1).cast("int").alias(c) for i, c in enumerate("abce")])
    got = dict(n.groupBy(A.match_code("a", "b", "c", "e").alias("k")).count().collect())
    assert got == {1: 11664, 2: 5556, 3: 3164, 4: 1560, 5: 18961, 6: 3338, 7: 1540, 8: 264, None: 4578}


def test_parse_variants(spark):
    rows = [("1:10177_A_AC",), ("1:10352_T_TA",), ("1:10539_C_A",), ("chr1:10540_C_N",), ("X:5-G:T",), ("chr1:0_A_C",), ("1:1_A",), ("chrom",), ("",), (None,)]
    p = C.parse_variant("t")
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(p["chrom"], p["pos"], A.letter_of(p["ref"]), A.letter_of(p["alt"])).collect()]
    assert got[:5] == [(1, 10177, "A", "A"), (1, 10352, "T", "T"), (1, 10539, "C", "A"), (1, 10540, "C", "N"), (23, 5, "G", "T")]
    assert got[5][1] is None and got[6:] == [(None,) * 4] * 4


def test_chromosome_codes(spark):
    rows = [("chrX",), ("Y",), ("22",), ("CHR3",), ("25",), ("0",), ("q",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(C.chrom_code("t")).collect()]
    assert got == [23, 24, 22, 3, None, None, None, None]


def test_distances(spark):
    r = lambda p: C.distance_region_variant(F.lit(23), F.lit(100), F.lit(200), F.lit(23), F.lit(p))
    rr = lambda s, e: C.distance_regions(F.lit(23), F.lit(100), F.lit(200), F.lit(23), F.lit(s), F.lit(e))
    v = lambda a, b: C.distance_variants(F.lit(1), F.lit(a), F.lit(1), F.lit(b))
    assert one(spark, r(120), r(220), r(90)) == [0, 20, -10]
    assert one(spark, rr(100, 200), rr(120, 250), rr(90, 250), rr(90, 91), rr(201, 202)) == [0, 0, 0, -9, 2]
    assert one(spark, v(15, 10), v(10, 15), C.distance_variants(F.lit(1), F.lit(3), F.lit(2), F.lit(3))) == [5, -5, None]


def test_half_open_and_closed(spark):
    a = [F.lit(x) for x in (1, 1, 1892607, 1, 1892607, 3582736)]
    assert one(spark, C.overlaps(*a), C.overlaps(*a, closed=True)) == [False, True]


def test_midpoints_round_to_even(spark):
    assert one(spark, C.midpoint(F.lit(10), F.lit(15)), C.midpoint(F.lit(10), F.lit(17))) == [12, 14]


def test_packing_round_trip_and_order(spark):
    rows = [(c, p, r, a) for c in (1, 23, 24) for p in (1, 2**31 - 1, 2**42 - 1) for r in (1, 15) for a in (2, 8)]
    df = spark.createDataFrame(rows, "chrom int, pos bigint, ref int, alt int").withColumn("k", C.pack_variant())
    u = C.unpack_variant("k")
    assert [tuple(x) for x in df.orderBy("k").select(*u.values()).collect()] == sorted(rows)
    assert one(spark, C.pack_variant(F.lit(40), F.lit(1), F.lit(1), F.lit(1)), C.pack_region(F.lit(1), F.lit(1), F.lit(1 << 29))) == [None, None]


def test_legacy_layout(spark):
    packed = (4 << 56) | (1 << 48) | (12345 << 5) | 7
    u = C.unpack_legacy_variant(F.lit(packed).cast("bigint"))
    assert one(spark, u["chrom"], u["pos"], u["ref"], u["alt"]) == [7, 12345, 1, 4]


def test_genotype_bytes(spark):
    d = F.array(*[F.lit(x) for x in (0, 2)], F.lit(None).cast("int"), F.lit(2), F.lit(2), F.lit(2))
    got = one(spark, F.hex(G.pack_dosages(d)), G.unpack_dosages(F.unhex(F.lit("DC0F")), 6), G.format_dosages(G.unpack_dosages(F.unhex(F.lit("DC")), 4)), G.allele_frequency(d), G.allele_frequency(d, skip_missing=True))
    assert got == ["DC0F", [0, 2, None, 2, 2, 2], "0/0;1/1;./.;1/1", None, 0.8]
    assert one(spark, G.unpack_dosages(F.unhex(F.lit("E70F")), 6), G.unpack_dosages(F.unhex(F.lit("6B01")), 6)) == [[2, None, 1, 2, 2, 2], [2, 1, 1, None, None, 0]]
    empty = F.array().cast("array<int>")
    assert one(spark, F.length(G.pack_dosages(empty)), G.unpack_dosages(F.unhex(F.lit("")), 0), G.allele_frequency(empty)) == [0, [], None]


def test_haplotype_words(spark):
    bits = [(i * 7 % 3 == 0) * 1 for i in range(130)]
    b = F.array(*[F.lit(x) for x in bits])
    w = G.pack_bits(b)
    got = one(spark, G.unpack_bits(w, 130), G.popcount(w), G.shared_bits(w, w), F.size(w), G.format_bits(G.pack_bits(G.parse_bits(F.lit("0 1 0 0 0"))), 5))
    assert got == [bits, sum(bits), sum(bits), 3, "01000"]


def test_texts(spark):
    got = one(spark, A.strand_flip(F.lit("A,C")), A.strand_flip(F.lit("A,C"), reverse=True), A.strand_flip(F.lit("AC")), C.rsid_number(F.lit("rs12x")), C.rsid_number(F.lit("12")), C.rsid_text(F.lit(5)), C.chrom_label(F.lit(24)))
    assert got == ["T,G", "G,T", None, 12, None, "rs5", "chrY"]
    flips = [("A,C", "A,C", 1), ("A,C", "C,A", -1), ("A,C", "T,G", -1), ("A,C", "G,T", 1), ("A,C", "A,G", 0), ("A,A", "A,A", 0), ("AC", "AC", 1), ("AC", "A,C", 0)]
    df = spark.createDataFrame(flips, "q string, t string, want int")
    assert df.where(A.flip_code("q", "t") != F.col("want")).count() == 0
