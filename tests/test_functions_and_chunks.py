"""SQL functions against the expressions of their names, line ranges, and chunks that come twice."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from locusframe.functions import alleles as A
from locusframe.functions import coords as C
from locusframe.functions import genotypes as G
from locusframe.functions.sql import FUNCTIONS, register_functions
from locusframe.plans.queries import QUERIES
from locusframe.sources import lines, text
from locusframe.streaming import chunks

DIR = "/root/testdata/sf0.001"

#: The expression for each SQL function; its arguments are the parameters by name.
EXPRESSIONS = {
    "chrom_code": C.chrom_code,
    "chrom_label": C.chrom_label,
    "rsid_number": C.rsid_number,
    "rsid_text": C.rsid_text,
    "mask_of": A.mask_of,
    "letter_of": A.letter_of,
    "complement": A.complement,
    "is_strand_ambiguous": A.is_strand_ambiguous,
    "match_code": A.match_code,
    "match_label": A.match_label,
    "is_reversed": A.is_reversed,
    "strand_flip": A.strand_flip,
    "pack_variant": C.pack_variant,
    "pack_region": C.pack_region,
    "unpack_variant": C.unpack_variant,
    "unpack_region": C.unpack_region,
    "parse_variant": C.parse_variant,
    "parse_region": C.parse_region,
    "format_variant": C.format_variant,
    "format_region": C.format_region,
    "overlaps": C.overlaps,
    "contains": C.contains,
    "holds": C.holds,
    "distance_variants": C.distance_variants,
    "distance_region_variant": C.distance_region_variant,
    "distance_regions": C.distance_regions,
    "common_region": lambda c1, s1, e1, c2, s2, e2: dict(zip(("start", "end"), C.common_region(c1, s1, e1, c2, s2, e2), strict=True)),
    "region_width": C.width,
    "midpoint": C.midpoint,
}
TEXTS = ["chr1", "CHRx", "Y", "0", "24", "25", "007", "rs12", "rs", "rsx1", "a", "u", "N", "-", "", "A,C", "T,G", "1:5_A_C", "chrX:7-AT-G", "chr30:5_A_C", "3:0_A_C", "chr2:5_9", "2:0_4", "Y:5:9", "é", None]


@pytest.fixture(scope="module")
def values(spark):
    """Some hundreds of rows with a column for each parameter's name; small numbers meet each other, a NULL in each column."""
    numbers = {"code": 26, "mask": 18, "letter": 0, "qr": 17, "qa": 17, "tr": 17, "ta": 17, "ref": 17, "alt": 17, "chrom": 33, "c1": 3, "c2": 3}
    longs = ["n", "k", "pos", "s", "e", "s1", "e1", "s2", "e2", "p", "p1", "p2"]
    rows = spark.range(0, 3000, 1, 4)
    draw = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n + 1))
    kept = lambda name, x: F.when(draw(name + "?", 30) > 0, x)
    texts = F.array(*[F.lit(t) for t in TEXTS])
    columns = {n: kept(n, draw(n, m).cast("int") - 1) for n, m in numbers.items() if m} | {n: kept(n, draw(n, 20)) for n in longs}
    columns["k"] = kept("k", C.pack_variant(F.lit(3), draw("k", 99) + 1, F.lit(1), F.lit(8)))
    columns |= {n: F.element_at(texts, (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(TEXTS))) + 1).cast("int")) for n in ("label", "t", "letter", "pair")}
    return rows.select("id", *[c.alias(n) for n, c in columns.items()]).cache()


def test_every_sql_function_has_an_expression():
    assert [f[0] for f in FUNCTIONS] == list(EXPRESSIONS)


@pytest.mark.parametrize("function", FUNCTIONS, ids=[f[0] for f in FUNCTIONS])
def test_sql_function_gives_what_the_expression_gives(spark, values, function):
    name, parameters = function[0], [p.split()[0] for p in function[1].split(", ")]
    register_functions(spark)
    want = EXPRESSIONS[name](*parameters)
    called = f"locus_{name}({', '.join(parameters)})"
    parts = {f"{called}.{k}": c for k, c in want.items()} if isinstance(want, dict) else {called: want}
    for sql, column in parts.items():
        rows = spark.sql(f"SELECT id, {sql} AS got, * EXCEPT (id) FROM {{v}}", v=values).select("got", column.alias("want"), *parameters)
        assert rows.schema["got"].dataType == rows.schema["want"].dataType
        assert rows.where("NOT (got <=> want)").take(3) == []
        assert rows.where("got IS NOT NULL").take(1)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
def test_sql_functions_need_no_python(spark):
    plan = QUERIES["sql_functions"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_functions_take_a_prefix_and_are_made_anew(spark):
    assert register_functions(spark, "g_") == register_functions(spark, "g_")
    assert spark.sql("SELECT g_format_variant(3, 5L, 1, NULL) AS x").first()["x"] == "chr3:5_A_NA"


def test_lines_are_read_by_their_ranges(spark, tmp_path):
    folder, want = tmp_path / "h", []
    folder.mkdir()
    for i, n in enumerate((7, 1, 30)):
        rows = ["é" * (j % 3) + f"{i}:{j}" for j in range(n)]
        (folder / f"part {i}").write_text("\n".join(rows) + ("" if i == 2 else "\n"))
        want += rows
    index = lines.line_index(spark, str(folder), rows=4).cache()
    every = spark.range(-3, 60).select(F.col("id").alias("line"))
    got = sorted(tuple(r) for r in lines.read_line_ranges(index, every.union(every)).collect())
    assert got == list(enumerate(want))
    some = spark.createDataFrame([(9,), (9,), (37,), (None,), (99,)], "line bigint")
    ranges = lines.ranges_of(index, some).collect()
    assert len(ranges) == 2 and sum(r["size"] for r in ranges) < sum(len(x.encode()) + 1 for x in want) / 3
    assert sorted(tuple(r) for r in lines.read_line_ranges(index, some).collect()) == [(9, want[9]), (37, want[37])]


def test_haplotypes_by_ranges_equal_those_by_scan(spark, tmp_path):
    (tmp_path / "l").write_text("id position a0 a1\n" + "".join(f"rs{j} {j} A C\n" for j in range(100)))
    (tmp_path / "h").write_text("".join(" ".join(f"{j:010b}") + "\n" for j in range(100)))
    a, b = str(tmp_path / "l"), str(tmp_path / "h")
    index = lines.line_index(spark, b, rows=8)
    regions = spark.createDataFrame([(19, 20, 40), (19, 30, 33), (19, 90, 91)], "chrom int, start bigint, end bigint")
    rows = lambda i: sorted((r["rsid"], r["b"]) for r in text.hap_by_regions(spark, a, b, 19, regions, i).select("rsid", G.format_bits("words", 10).alias("b")).collect())
    assert rows(index) == rows(None) == [(j, f"{j:010b}") for j in [*range(20, 40), 90]]


def test_an_empty_file_and_packed_files_have_no_ranges(spark, tmp_path):
    (tmp_path / "none").write_text("")
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"0 1\n"))
    index = lines.line_index(spark, str(tmp_path / "none"))
    assert lines.read_line_ranges(index, spark.createDataFrame([(0,)], "line bigint")).count() == 0
    with pytest.raises(Exception, match="compressed files have no ranges"):
        lines.line_index(spark, str(tmp_path / "x.gz")).collect()


def _source(spark, tmp_path, n=5):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    for i in range(n):
        df.where(F.col("id") % n == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, *(str(tmp_path / x) for x in ("in", "out", "state"))


def test_chunks_go_through_a_function_once(spark, tmp_path):
    df, source, out, state = _source(spark, tmp_path)
    sizes = []

    def make(rows):
        sizes.append(rows.count())
        return rows.where("g = 1").groupBy("g").agg(F.count("*").alias("n"))

    got = chunks.each_chunk(spark, source, df.schema, make, out, state, files=2)
    assert sizes[0] == 0 and sorted(sizes[1:]) == [20, 40, 40]
    assert [tuple(r) for r in got.groupBy("g").agg(F.sum("n")).collect()] == [(1, 33)]
    spark.range(100, 110).select("id", F.lit(1).cast("bigint").alias("g")).write.mode("append").parquet(source)
    more = chunks.each_chunk(spark, source, df.schema, make, out, state, files=20)
    assert sum(sizes) == 110 and more.agg(F.sum("n")).first()[0] == 43


def test_a_chunk_that_spark_runs_again_is_not_doubled(spark, tmp_path):
    df, source, out, state = _source(spark, tmp_path)
    keep = lambda rows: rows
    assert chunks.each_chunk(spark, source, df.schema, keep, out, state).count() == 100
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)  # as if the driver had died after the chunk's rows were written and before that was noted
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    seen = []
    again = chunks.each_chunk(spark, source, df.schema, lambda rows: seen.append(rows.count()) or rows, out, state)
    assert seen == [0, 20]
    assert sorted(r["id"] for r in again.collect()) == list(range(100))


def test_a_function_that_fails_leaves_its_chunk_for_the_next_run(spark, tmp_path):
    df, source, out, state = _source(spark, tmp_path)

    def fail(rows):
        if rows.where("id = 2").count():
            raise ValueError("not this one")
        return rows

    with pytest.raises(Exception, match="not this one"):
        chunks.each_chunk(spark, source, df.schema, fail, out, state)
    assert chunks.read_chunks(spark, out).where("id = 2").count() == 0
    assert sorted(r["id"] for r in chunks.each_chunk(spark, source, df.schema, lambda rows: rows, out, state).collect()) == list(range(100))


def test_chunks_of_an_empty_folder_keep_their_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = chunks.each_chunk(spark, str(tmp_path / "in"), spark.range(1).schema, lambda r: r.select("id", F.lit("x").alias("tag")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.columns == ["id", "tag"] and got.count() == 0


def test_match_codes_of_all_sets_of_alleles(spark):
    turn = lambda m: int(f"{m:04b}"[::-1], 2)

    def code(a, b, c, e):
        for i, (x, y, u, v) in enumerate(((a, c, b, e), (a, e, b, c), (turn(a), c, turn(b), e), (turn(a), e, turn(b), c)), 1):
            if x & y and u & v:
                return i if (x & y).bit_count() + (u & v).bit_count() == 2 else i + 4

    quads = spark.range(15**4).select(*[(F.floor(F.col("id") / 15**i) % 15 + 1).cast("int").alias(c) for i, c in enumerate("abce")])
    rows = quads.withColumn("code", A.match_code("a", "b", "c", "e")).collect()
    assert len(rows) == 15**4 and all(r["code"] == code(r["a"], r["b"], r["c"], r["e"]) for r in rows)
