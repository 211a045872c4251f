"""The pipeline's stages, each on what its predecessor kept."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, before, DIR).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        counts.append(after.count())
        if name != "mixing sources to target weights":
            assert after.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        before = after
    assert counts[0] > counts[1] > counts[2] > counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    of = Counter(r["doc_id"] for r in before.select("doc_id").collect())
    got = {r["doc_id"]: r["n"] for r in packed.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == dict(of)
    good = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").select("doc_id")
    n = docs.join(good, "doc_id", "left_semi").count()
    kept = corpus_pipeline.classify(spark, docs, DIR).join(good, "doc_id", "left_semi").count()
    assert kept >= 0.97 * n


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of documents with nulls, empty and long texts, repeated rows, a doc_id with two texts, copies, and further columns."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randrange(80, 200)), "en", f"s{i % 3}", 1) for i in range(40)]
    near = rows[3][1].split(" ")
    near[40] = "other"
    rows += [(100, rows[2][1], "en", "s0", 1), (101, " ".join(near), None, None, None), (7, text(100), "en", "s1", 1), rows[5], rows[5], (None, text(90), "en", "s1", 1), (None, None, None, None, None), (200, None, "en", "s1", None), (201, "", "en", "s1", 0), (202, text(15_000), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(i) for i, c in enumerate(("key", "score", "rep", "component_id", "times", "rows", "__rows", "__text", "text_hash", "c0", "c1"))})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 0, 0), (41, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_on_odd_tables(spark, odd):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.classify(spark, docs, folder).count() == len(rows)  # labels of one kind
    ruled = corpus_pipeline.rules(spark, docs, folder)
    assert ruled.columns == docs.columns and {r["doc_id"] for r in ruled.collect()} & {200, 201} == set()
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = Counter(dict.fromkeys([(r[0], r[1]) for r in rows if r[0] is not None and r[0] not in (100, 101)], 1)) + Counter([(r[0], r[1]) for r in rows if r[0] is None])
    assert got == want
    mixed = corpus_pipeline.mix(spark, docs, folder)
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.pack(spark, docs, folder)
    assert pieces.where("start = 0").count() == len(rows)
    assert corpus_pipeline.run(spark, folder).where("doc_id = 100").count() == 0


def test_stages_on_empty_tables(spark, odd, tmp_path):
    folder, _ = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("doc_id < -1").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id IS NOT NULL")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, up = {}, {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
        up[r["doc_id"]] = r["doc_id"]

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= corpus_pipeline.SIMILAR * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()} == {i for i in sets if find(i) == i}


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
