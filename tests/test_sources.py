"""Files of small known content."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import genotypes as G
from locusframe.plans.source_queries import QUERIES
from locusframe.sources import plink, sequences, store, text

DIR = "/root/testdata/sf0.001"


def test_plink_golden_bytes(spark, tmp_path):
    prefix = str(tmp_path / "p")
    (tmp_path / "p.bim").write_text("1\tsnp1\t0\t1\tG\tA\n1\tsnp2\t0\t2\tC\tA\n1\tsnp3\t0\t3\tA\tC\n")
    (tmp_path / "p.fam").write_text("".join(f"{i} 1 0 0 1 {i % 2}\n" for i in range(6)))
    (tmp_path / "p.bed").write_bytes(bytes.fromhex("6c1b01dc0fe70f6b01"))
    rows = plink.read_plink(spark, prefix).orderBy("variant_index").collect()
    assert [r["dosages"] for r in rows] == [[0, 2, None, 2, 2, 2], [2, None, 1, 2, 2, 2], [2, 1, 1, None, None, 0]]
    assert [(r["ref"], r["alt"]) for r in rows] == [(1, 4), (1, 2), (2, 1)]
    back = str(tmp_path / "back.bed")
    plink.write_bed_genotypes(plink.read_plink(spark, prefix), back)
    plink.write_bed_genotypes(plink.read_plink(spark, prefix).where("variant_index = 1"), back, append=True)
    assert open(back, "rb").read() == bytes.fromhex("6c1b01dc0fe70f6b01e70f")
    keep = spark.createDataFrame([(2,)], "variant_index bigint")
    assert [r["variant_index"] for r in plink.read_bed_genotypes(spark, f"{prefix}.bed", 6, 3, keep, part=1).collect()] == [2]
    (tmp_path / "bad.bed").write_bytes(b"xxx")
    with pytest.raises(Exception, match="binary genotype format"):
        plink.read_bed_genotypes(spark, str(tmp_path / "bad.bed"), 6, 3).collect()


def test_bed_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chrom\tstart\tend\nchr1\t5\t9\nX\t1\t2\n")
    (tmp_path / "b.bed").write_text("chr1\t5\t9\n")
    assert sorted(tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [(1, 5, 9), (23, 1, 2)]
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [(1, 5, 9)]
    assert text.read_bed(spark, str(tmp_path / "b.bed"), header=True).count() == 0


def test_legend_and_haplotypes(spark, tmp_path):
    with gzip.open(tmp_path / "EUR.chr19.legend.gz", "wt") as f:
        f.write("id position a0 a1\nrs5:1:A:C 10 A C\nrs6 20 AT G\n19:30 30 G T\n")
    (tmp_path / "EUR.chr19.hap").write_text("0 1 0 0 0\n1 1 1 1 1\n0 0 0 0 1\n")
    legend = text.read_legend(spark, str(tmp_path / "EUR.chr19.legend.gz")).orderBy("pos").collect()
    assert [tuple(r) for r in legend] == [(19, 5, 10, 1, 2), (19, 6, 20, 1, 4), (19, None, 30, 4, 8)]
    ids = spark.createDataFrame([(6,)], "rsid bigint")
    a, b = str(tmp_path / "EUR.chr19.legend.gz"), str(tmp_path / "EUR.chr19.hap")
    got = text.hap_by_rsid(spark, a, b, 19, ids).select("pos", "n", G.popcount("words").alias("k")).collect()
    assert [tuple(r) for r in got] == [(20, 5, 5)]
    near = spark.createDataFrame([(19, 5, 25), (3, 1, 99)], "chrom int, start bigint, end bigint")
    assert text.hap_by_regions(spark, a, b, 19, near).count() == 2


def test_genetic_map(spark, tmp_path):
    (tmp_path / "CEU-chr2.txt").write_text("Position(bp)\tRate\tMap\tFiltered\n10\t1\t0.1\t0\n20\t1\t0.2\t1\n30\t1\t\t0\n")
    with pytest.raises(Exception, match="missing value"):
        text.read_genetic_map(spark, str(tmp_path / "CEU-chr2.txt")).collect()
    (tmp_path / "CEU-chr2.txt").write_text("Position(bp)\tRate\tMap\tFiltered\n10\t1\t0.1\t0\n20\t1\t0.2\t1\n")
    assert [tuple(r) for r in text.read_genetic_map(spark, str(tmp_path / "CEU-chr2.txt")).collect()] == [(2, 10, 0.1)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
def test_genetic_map_of_every_chromosome(spark):
    from locusframe.plans import source_queries as q
    from locusframe.plans.views import KNOTS, view

    want = sorted((r["chrom"], r["pos"]) for r in view(spark, DIR, KNOTS).where("pos % 3 <> 0").collect())
    got = sorted((r["chrom"], r["pos"]) for r in q.genetic_map_read(spark, DIR).collect())
    assert got == want and {c for c, _ in got} == set(range(1, 25))


def test_fasta(spark, tmp_path):
    seq = "ACGT" * 40
    body = "\n".join(seq[i : i + 50] for i in range(0, len(seq), 50))
    (tmp_path / "x.fa").write_text(f">one first\n{body}\n>two\nTTN\n")
    path = str(tmp_path / "x.fa")
    assert sorted(tuple(r) for r in sequences.read_fasta(spark, path).select("name", "seq").collect()) == [("one", seq), ("two", "TTN")]
    lines = sequences.read_fasta_lines(spark, path)
    at = spark.createDataFrame([(1, p) for p in (1, 50, 51, 101, 160)] + [(2, 3)], "record bigint, pos bigint")
    for width in (None, 50):
        got = {(r["record"], r["pos"]): r["base"] for r in sequences.bases_at(lines, at, width).collect()}
        assert got == {(1, p): seq[p - 1] for p in (1, 50, 51, 101, 160)} | {(2, 3): "N"}


def test_fasta_of_several_split_files(spark, tmp_path):
    want = {}
    for f, letters in enumerate(("ACGT", "GGC", "TA")):
        records = {f"r{f}_{i}": (letters * 2000)[: 700 * (i + 1) + 13 * f] for i in range(6)}
        (tmp_path / f"{f}.fa").write_text("".join(f">{n} x\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in records.items()))
        want |= records
    conf = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        got = [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path)).select("name", "seq").collect()]
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert sorted(got) == sorted(want.items())


def test_block_gzip(spark, tmp_path):
    lines = [f"line {i}" for i in range(500)]
    data = sequences.bgzf_compress("\n".join(lines).encode(), block=700)
    assert gzip.decompress(data).decode().split("\n") == lines
    (tmp_path / "x.bgz").write_bytes(data)
    got = sequences.read_bgzf_lines(spark, str(tmp_path / "x.bgz")).orderBy("line").collect()
    assert [r["value"] for r in got] == lines
    blocks = sequences.read_bgzf(spark, str(tmp_path / "x.bgz"))
    assert blocks.count() == len(list(sequences.bgzf_blocks(data))) and blocks.agg(F.sum("size")).first()[0] == len(data)


@pytest.mark.parametrize("block", [7, 40, 4000])
def test_block_gzip_in_parts_of_any_size(spark, tmp_path, block):
    """Lines and blocks are the same however a file is dealt to tasks, whether blocks end in lines, at their ends or within one character."""
    rng = random.Random(block)
    lines = ["".join(rng.choice("abé\x1f\x8b") for _ in range(rng.choice([0, 0, 3, 6, 60, 900]))) for _ in range(120)]
    for ending in ("", "\n"):
        path = tmp_path / f"x{len(ending)}.bgz"
        path.write_bytes(sequences.bgzf_compress(("\n".join(lines) + ending).encode(), block))
        want = list(enumerate(lines if ending or lines[-1] else lines[:-1]))
        blocks = list(sequences.bgzf_blocks(path.read_bytes()))
        for part in (1000, 50_000):
            got = sequences.read_bgzf_lines(spark, str(path), part=part)
            assert sorted((r["line"], r["value"]) for r in got.collect()) == want
        got = sequences.read_bgzf(spark, str(path), part=3000).orderBy("block").collect()
        assert [(r["offset"], r["size"]) for r in got] == blocks and [r["block"] for r in got] == list(range(len(blocks)))
        assert b"".join(r["data"] for r in got) == ("\n".join(lines) + ending).encode()


def test_parts_of_one_block_gzip_file_are_tasks_of_their_own(spark, tmp_path):
    (tmp_path / "a.bgz").write_bytes(sequences.bgzf_compress("".join(f"{i * 7919 % 100003}\n" for i in range(50_000)).encode(), 1000))
    lines = sequences.read_bgzf_lines(spark, str(tmp_path / "a.bgz"), part=20_000)
    assert lines.count() == 50_000 and lines.where("value <> CAST(line * 7919 % 100003 AS STRING)").isEmpty()
    assert spark.read.format("bgzf").options(files=json.dumps([[str(tmp_path / "a.bgz"), os.path.getsize(tmp_path / "a.bgz")]]), part="20000").load().rdd.getNumPartitions() > 5
    (tmp_path / "empty.bgz").write_bytes(b"")
    assert sequences.read_bgzf_lines(spark, str(tmp_path / "empty.bgz")).count() == 0
    with pytest.raises(Exception, match="no file is named"):
        sequences.read_bgzf_lines(spark, str(tmp_path / "none.bgz"))


def test_fasta_index_reads_single_bytes(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 10, 11, 25, 400])}
    parts = [list(seqs.items())[:3], list(seqs.items())[3:]]
    for i, part in enumerate(parts):
        (tmp_path / f"{i}.fa").write_text("".join(f">{n} more\n" + "".join(s[j : j + 10] + "\n" for j in range(0, len(s), 10)) for n, s in part))
    index = sequences.fasta_index(spark, str(tmp_path))
    got = {r["name"]: (r["length"], r["width"]) for r in index.collect()}
    assert got == {n: (len(s), min(10, len(s)) or None) for n, s in seqs.items()}
    at = index.select("record", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("length") + 2)).alias("pos"))
    found = sequences.bases_by_index(index, at).join(index.select("record", "name"), "record").collect()
    assert sorted((r["name"], r["pos"], r["base"]) for r in found) == sorted((n, i + 1, b) for n, s in seqs.items() for i, b in enumerate(s))
    (tmp_path / "bad.fa").write_text(">x\nACGT\nACG\nACGT\n")
    with pytest.raises(Exception, match="one width"):
        sequences.fasta_index(spark, str(tmp_path / "bad.fa")).collect()


def test_fasta_index_deals_lines_by_the_bytes_of_files(spark, tmp_path, monkeypatch):
    """By bytes of shuffled figures, one task sorted the lines of nearly all stretches."""
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text("".join(f">r{k}{i}\nACGTAC\nGT\n" for i in range(50)))
    want = sorted(sequences.fasta_index(spark, str(tmp_path)).drop("path").collect())
    monkeypatch.setattr(sequences, "DEALT", 100)
    index = sequences.fasta_index(spark, f"{tmp_path}/*.fa")
    assert sorted(index.drop("path").collect()) == want and len(want) == 150
    size = sum(f.stat().st_size for f in tmp_path.glob("*.fa"))
    assert f"{1 + size // 100}), REPARTITION_BY_NUM" in index._jdf.queryExecution().executedPlan().toString()


def test_only_the_ranges_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "x.bed")
    plink.write_bed_genotypes(spark.range(1000).select(F.col("id").alias("variant_index"), F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("data")), path)
    with open(path, "r+b") as f:
        f.truncate(3 + 2 * 800)  # a file cut short is no error for what lies before the cut
    read = lambda ranges: plink.read_bed_genotypes(spark, path, 8, 1000, part=100, ranges=ranges)
    for ranges, tasks in (([(5, 6)], 1), ([(7, 9), (500, 501)], 2), ([(250, 380)], 2), ([(3, 10), (5, 20), (20, 25), (9, 9)], 1), ([], 1), ([(-5, 1)], 1)):
        own = read(ranges)
        assert own.select("variant_index").rdd.getNumPartitions() == tasks
        got = {r["variant_index"]: int.from_bytes(r["data"], "big") for r in own.collect()}
        assert got == {i: i for i in range(1000) if any(a <= i < b for a, b in ranges)}
    both = read([(5, 6)]).union(read([(7, 8)])).union(read([(0, 3)]).where("variant_index > 1"))
    assert sorted(r["variant_index"] for r in both.collect()) == [2, 5, 7]
    with pytest.raises(Exception, match="ends before"):
        read([(5, 6), (811, 812)]).count()


def test_a_genotype_write_that_fails_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "x.bed")
    good = spark.range(50).select(F.col("id").alias("variant_index"), F.unhex(F.lit("0A0B")).alias("data"))
    save = lambda df: df.write.format("plink_bed").mode("append").option("path", path).save()
    plink._source(spark)
    broken = good.withColumn("data", F.when(F.col("variant_index") == 40, F.raise_error(F.lit("no genotype")).cast("binary")).otherwise(F.col("data")))
    for bad, why in ((broken, "no genotype"), (good.where("variant_index <> 7"), "without gaps"), (good.unionAll(good.limit(1)), "without gaps")):
        with pytest.raises(Exception, match=why):
            save(bad)
        assert os.listdir(tmp_path) == []
    save(good)
    assert os.path.getsize(path) == 3 + 100 and os.listdir(tmp_path) == ["x.bed"]
    with pytest.raises(Exception, match="there already"):
        save(good)


def test_regions_open_only_the_files_that_they_touch(spark, tmp_path):
    df = spark.range(24_000).select((1 + F.col("id") % 24).cast("int").alias("chrom"), (F.col("id") * 10).alias("pos"))
    path = str(tmp_path / "s")
    store.write_store(df, path, files_per_chrom=3)
    assert spark.read.parquet(path).count() == 24_000  # the manifest is no part of the data
    r = spark.createDataFrame([(2, 1000, 1500), (2, 1400, 2000), (7, 100_000, 100_300), (3, 10**9, 10**9 + 5), (None, 1, 5)], "chrom int, start bigint, end bigint")
    rows = store.read_regions(spark, path, r)
    want = df.where("(chrom = 2 AND pos >= 1000 AND pos < 2000) OR (chrom = 7 AND pos >= 100000 AND pos < 100300)")
    assert sorted(tuple(x) for x in rows.select("chrom", "pos").collect()) == sorted(tuple(x) for x in want.collect())
    assert 1 <= len(rows.inputFiles()) <= 4 < len(spark.read.parquet(path).inputFiles())
    assert store.read_regions(spark, path, r.where("chrom IS NULL")).count() == 0


def test_store(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3 + 1).cast("int").alias("chrom"), F.col("id").alias("pos"), F.col("id").alias("rsid"))
    path = str(tmp_path / "s")
    store.write_store(df, path, files_per_chrom=1)
    assert store.read_region(spark, path, 2, 100, 200).count() == 34
    r = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (3, 990, 2000)], "chrom int, start bigint, end bigint")
    assert store.read_regions(spark, path, r).count() == 7 and store.read_rsids(spark, path, spark.createDataFrame([(5,)], "rsid bigint"), allow_missing=False).count() == 1


@pytest.fixture
def small_splits(spark):
    """Small splits, many to a partition, and parts as they come."""
    conf = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in old.items():
        spark.conf.set(k, x)


def test_lines_are_numbered_by_file_and_place(spark, tmp_path, small_splits):
    sizes, want = [5, 400, 1, 90, 250], []
    for i, n in enumerate(sizes):
        rows = [f"{i}_{j}" for j in range(n)]
        (tmp_path / f"part-{i}.txt").write_text("\n".join(rows) + "\n")
        want += rows
    got = {r["line"]: r["value"] for r in text.with_line_number(spark.read.text(str(tmp_path))).collect()}
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_plink_of_several_parts_reads_back_what_was_written(spark, tmp_path, small_splits):
    n = 3000
    v = spark.range(n).select(F.col("id").alias("variant_index"), (F.col("id") % 22 + 1).cast("int").alias("chrom"), F.col("id").alias("rsid"), (F.col("id") * 7 + 1).alias("pos"), F.lit(1).alias("ref"), F.lit(2).alias("alt"))
    dose = F.array(*[F.when((F.col("variant_index") + i) % 5 == 0, F.lit(None)).otherwise((F.col("variant_index") * 3 + i) % 3) for i in range(6)]).cast("array<int>")
    v = v.withColumn("dosages", dose).repartition(7, "rsid")
    fam = spark.range(6).selectExpr("'f' AS fid", "CAST(id AS STRING) AS iid", "'0' AS father_id", "'0' AS mother_id", "1 AS sex", "1.0D AS phenotype")
    plink.write_plink(v, fam, str(tmp_path / "x"))
    assert len([f for f in os.listdir(tmp_path / "x.bim") if f.endswith(".csv")]) > 1
    want = {r["rsid"]: (r["chrom"], r["pos"], r["dosages"]) for r in v.collect()}
    got = {int(r["rsid"][2:]): (r["chrom"], r["pos"], r["dosages"]) for r in plink.read_plink(spark, str(tmp_path / "x")).collect()}
    assert got == want


def test_haplotypes_of_several_parts_meet_their_legend(spark, tmp_path, small_splits):
    at = 0
    for i, n in enumerate((40, 3, 200)):
        (tmp_path / "l").mkdir(exist_ok=True)
        (tmp_path / "h").mkdir(exist_ok=True)
        (tmp_path / "l" / f"{i}").write_text("id position a0 a1\n" + "".join(f"rs{at + j} {at + j} A C\n" for j in range(n)))
        (tmp_path / "h" / f"{i}").write_text("".join(" ".join(f"{at + j:010b}") + "\n" for j in range(n)))
        at += n
    got = text.read_hap_with_legend(spark, str(tmp_path / "l"), str(tmp_path / "h"), 19).select("rsid", G.format_bits("words", 10).alias("b")).collect()
    assert {r["rsid"]: r["b"] for r in got} == {i: f"{i:010b}" for i in range(at)}


def test_genotypes_of_unlike_widths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(0, b"ab"), (1, b"abc")], "variant_index bigint, data binary")
    with pytest.raises(Exception, match="differ in their number of samples"):
        plink.write_bed_genotypes(df, str(tmp_path / "x.bed"))


def test_regions_of_a_store_that_overlap_give_each_row_once(spark, tmp_path):
    df = spark.range(500).select(F.lit(1).alias("chrom"), F.col("id").alias("pos"))
    path = str(tmp_path / "s")
    store.write_store(df, path, files_per_chrom=1)
    r = spark.createDataFrame([(1, 10, 50), (1, 20, 30), (1, 40, 60), (2, 0, 9), (None, 0, 9), (1, 70, 70)], "chrom int, start bigint, end bigint")
    assert sorted(x["pos"] for x in store.read_regions(spark, path, r).collect()) == list(range(10, 60))


@pytest.fixture(scope="module")
def in_five_files(spark, tmp_path_factory):
    """The tables of DIR, each in five files of unlike sizes."""
    folder = str(tmp_path_factory.mktemp("five"))
    for name in ("orders", "part", "customer", "embeddings", "documents", "events"):
        spark.read.parquet(f"{DIR}/{name}.parquet").repartition(5).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["bed_roundtrip", "bim_roundtrip", "fam_roundtrip", "genetic_map_read", "hap_legend_read", "plink_bed_roundtrip", "plink_parts_roundtrip", "plink_bed_seek", "plink_bed_ranges", "hap_by_rsid_parts", "hap_by_regions_parts", "hap_by_line_ranges", "chunked_effects", "fasta_read", "fasta_bases", "fasta_bases_by_index", "bgzf_lines", "bgzf_lines_of_parts", "store_regions_read", "store_regions_by_files", "samples_read"])
def test_source_queries_do_not_depend_on_the_files_of_tables(spark, in_five_files, name):
    rows = lambda d: sorted(map(tuple, QUERIES[name](spark, d).collect()), key=str)
    assert rows(DIR) == rows(in_five_files)


def test_line_numbers_are_refused_where_rows_have_no_place(spark, tmp_path):
    (tmp_path / "a").write_text("b\na\n")
    lines = spark.read.text(str(tmp_path / "a"))
    assert text.with_line_number(lines.select("value")).count() == 2
    for df in (lines.orderBy("value"), lines.union(lines), lines.where("value > ''"), lines.join(lines.select("value"), "value"), lines.groupBy("value").count()):
        with pytest.raises(ValueError, match="line numbers as they are read"):
            text.with_line_number(df)


def test_a_stream_writes_a_variant_once_however_many_regions_hold_it(spark, tmp_path):
    from locusframe.streaming import joins

    r = spark.createDataFrame([(i, 1, 10 + i % 3, 20 + i % 2) for i in range(30)] + [(40, 2, 5, 5), (41, None, 1, 50), (42, 2, 7, None)], "rid int, chrom int, start bigint, end bigint")
    v = spark.createDataFrame([(i, 1 + i % 2, 5 + i % 20) for i in range(80)], "id int, chrom int, pos bigint")
    v.write.parquet(f"{tmp_path}/in")
    parts = joins.pieces(r)
    out = joins.regions_of_stream(spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in"), "id", parts, "piece")
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    held = [(i, x) for i, c, p in v.collect() for x, d, s, e in r.collect() if c == d and e is not None and s <= p < e]
    assert found.count() == len({i for i, _ in held}) < len(held)
    assert sorted(map(tuple, joins.regions_of_pieces(found, parts, r, "rid").select("id", "rid").collect())) == sorted(held)
