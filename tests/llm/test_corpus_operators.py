"""Corpus operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import math
import random
import re
import struct
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from locusframe.llm import embed_dedup, graph, html_text, labelled, lm_mixing, minhash_dedup, mixing, packing, quality_cnn, quality_rules, queries, sharding, texts, token_ids, token_records
from locusframe.llm.queries import tokenizer_path
from locusframe.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.choice([3, 40, 120, 300]))
        if rows and rng.random() < 0.4:
            w = rng.choice(rows)[1].split(" ") if rng.random() < 0.9 else t.split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "zz%d" % rng.randrange(9)
            t = " ".join(w)
        rows.append((i, t, "en", f"s{i % 5}", len(t)))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, " \n\t ", "en", "s0", 4), (1003, "One two\nONE two", "en", "s1", 15), (1004, "one TWO\none two", "en", "s1", 15)]
    rows += [rows[0], (None, "no id here at all", "en", "s2", 17), (None, None, None, None, None), (1005, prose(rng, 9000), "en", "s3", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- shared parts


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(8, 40)] + [(99, 99)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(Workspace(spark), spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in up}
    assert graph.connected_components(Workspace(spark), spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_word_hashes_split_like_the_pattern():
    rows = ["", None, "a", " b  c\x0bd\x0c", "é x ÀB", "A a", "w " * 2000]
    for size in (1, 1 << 20):
        seen = []
        for _, data, starts in texts.blocks(pa.array(rows), size):
            w = texts.Words(data, starts)
            for i in range(len(starts) - 1):
                seen.append([bytes(data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)])
        assert seen == [WORD.findall(r or "") for r in rows]
    _, data, starts = next(texts.blocks(pa.array(["A a", "aa a"])))
    low, own = texts.Words(data, starts).hash, texts.Words(data, starts, lower=False).hash
    assert low[0] == low[1] == low[3] and own[0] != own[1] and len(set(own.tolist())) == 3


# ---- 1, 2


def quality_rows(lines, seed=2, n=160):
    """Bad texts have signs after words, or else equal lines, or words said again and again."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, rng.randrange(60, 200))
        if not good:
            t = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split()) if i % 2 else "\n".join([prose(rng, 8)] * 30) if lines else " ".join(w for w in t.split()[:9] for _ in range(20))
        rows.append((i, t, "en", "s", 1))
        labels.append((i, int(good)))
    return rows, labels


def test_network_learns_and_scores_every_row(spark, docs, empty):
    rows, labels = quality_rows(lines=False)
    table = spark.createDataFrame(rows, DOCS)
    net = quality_cnn.train(table, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r["doc_id"]: r["score"] for r in quality_cnn.classify(table, net).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i in held]
    assert sum(right) / len(right) > 0.9
    scored = quality_cnn.classify(docs, net).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_cnn.classify(empty, net).count() == 0
    more = docs.withColumn("score", F.lit("x"))
    kept = quality_cnn.filter_docs(more, net)
    assert kept.columns == more.columns and kept.count() == sum(r["score"] >= 0.5 for r in scored)
    none = quality_cnn.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {round(r["score"], 9) for r in quality_cnn.classify(docs, none).collect()} == {0.5}


def test_network_score_does_not_depend_on_the_block():
    rng = np.random.default_rng(0)
    net = quality_cnn.fit([b"aaaa bbbb" * 20, b"### $$$ " * 30] * 4, np.array([1.0, 0.0] * 4))
    rows = ["", "x", "ab" * 3, "le le le le le " * 30, "".join(chr(rng.integers(32, 1000)) for _ in range(700))]
    at_once = [net.score(d, s).tolist() for _, d, s in texts.blocks(pa.array(rows), 1 << 20)][0]
    alone = [x for row in rows for _, d, s in texts.blocks(pa.array([row])) for x in net.score(d, s)]
    assert np.allclose(at_once, alone, rtol=1e-5)


def plain_statistics(t):
    w = WORD.findall(t or "")
    lines, seen, dup = [x for x in (t or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_rules_statistics_and_verdicts(spark, docs, empty):
    rows, labels = quality_rows(lines=True)
    table = spark.createDataFrame(rows, DOCS)
    trees = quality_rules.train(table, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    for part in (docs, table):
        text = {r["doc_id"]: r["text"] for r in part.collect() if r["doc_id"] is not None}
        for r in quality_rules.rules(part, trees).collect():
            if r["doc_id"] is not None:
                want = plain_statistics(text[r["doc_id"]])
                assert tuple(r[c] for c in quality_rules.BASE) == want
                assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
                assert not (r["base_failed"] and r["kept"])
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r["doc_id"]: r["kept"] for r in quality_rules.rules(table, trees).collect()}
    assert all(got[i] == bool(y) for i, y in held.items())
    assert quality_rules.rules(empty, trees).count() == 0
    more = docs.withColumn("kept", F.lit(1))
    assert quality_rules.filter_docs(more, trees).columns == more.columns


def test_rules_on_a_very_long_text():
    rng = random.Random(5)
    text = "\n".join([prose(rng, 30) for _ in range(12_000)] + ["y" * 300_000, "the same line", "the same line"])
    (_, data, starts), = texts.blocks(pa.array([text]))
    tracemalloc.start()
    alone = quality_rules.statistics(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)  # words of 5 bytes with their spaces; it was over 60
    both = quality_rules.statistics(*next(texts.blocks(pa.array(["a b", text]), 1 << 30))[1:])
    assert all(v[0] == both[k][1] for k, v in alone.items()) and alone["n_dup_lines"][0] == 1


def test_rules_hold_few_bytes_for_each_byte_of_a_long_text():
    text = " ".join(str(i % 2_500_000) + "\n" * (i % 30 == 0) for i in range(4_000_000))
    (_, data, starts), = texts.blocks(pa.array([text]))
    tracemalloc.start()
    quality_rules.statistics(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(data)


def test_rules_on_odd_long_texts():
    rng = random.Random(7)
    long = 1 << 20
    odd = ["a b c d a b c", "a\n\na\n", "x" * long, " " * long, "\n" * long, "a\n" * (long // 2), "a b " * (long // 4), "x" * long + " y z" * 9, ("w" * 200_000 + "\n") * 7, " " * 300_000 + "\nq\n" + " " * 300_000 + "q\n", "é ü\x00 " * (long // 6)]
    odd += ["".join(rng.choice("ab |#\n\t,A7é") for _ in range(rng.randrange(600_000, 900_000))) for _ in range(3)]
    for text in odd:
        (_, data, starts), = texts.blocks(pa.array([text]))
        alone = quality_rules.statistics(data, starts)
        assert tuple(alone[c][0] for c in quality_rules.BASE) == plain_statistics(text)
        both = quality_rules.statistics(*next(texts.blocks(pa.array(["a b", text]), 1 << 30))[1:])
        assert all(v.dtype == both[k].dtype and v[0] == both[k][1] for k, v in alone.items())


def test_rules_learn_without_a_shuffle_of_texts(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    taken = []
    table = quality_rules.table
    monkeypatch.setattr(quality_rules, "table", lambda df, *a: taken.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(df, *a))
    trees = quality_rules.train(docs, labels)
    assert len(trees.root) and "__row" not in taken[0]
    known = labelled.sample(docs.select("doc_id", "text"), labels, "doc_id", "quality")
    rows = table(known, "doc_id", "text", None, ["__label"]).orderBy("doc_id").collect()
    again = quality_rules.fit(np.array([[r[f] for f in quality_rules.FEATURES] for r in rows], float), np.array([r["__label"] for r in rows], float), list(quality_rules.FEATURES.values()))
    assert (trees.feature == again.feature).all() and (trees.value == again.value).all()


def test_trees_keep_the_order_of_constrained_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * np.sin(5 * x[:, 1]) + 0.3 * rng.normal(size=600) > 0).astype(float)
    trees = quality_rules.fit(x, y, [1, -1, 0])
    grid = np.linspace(-3, 3, 80)
    for base in x[:20]:
        for f, sign in ((0, 1), (1, -1)):
            line = np.tile(base, (80, 1))
            line[:, f] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8


def test_sample_leaves_out_the_held_out_fold(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    ids = [r["doc_id"] for r in labelled.sample(docs, labels, "doc_id", "quality", 50).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


# ---- 3, 4


def test_shards_only_draw_into_the_new_one(spark, docs, empty):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    both = sharding.shard(sharding.shard(keys, "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, out="grown")
    rows = both.collect()
    assert all(r["grown"] in (r["shard"], 16) for r in rows)
    n = Counter(r["shard"] for r in rows)
    assert len(n) == 16 and max(n.values()) < 1.2 * min(n.values())
    heavy = Counter(r["shard"] for r in sharding.shard(keys, "doc_id", [3.0, 1.0]).collect())
    assert abs(heavy[0] / 20000 - 0.75) < 0.02
    for table in (docs, both.repartition(7)):
        at = sharding.gapless(Workspace(spark), table if "shard" in table.columns else sharding.shard(table, "doc_id", [1.0] * 3), "shard", "slot", ["doc_id"])
        slots = defaultdict(list)
        for r in at.collect():
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == table.count()
    assert sharding.gapless(Workspace(spark), sharding.shard(empty, "doc_id", [1.0]), "shard", "slot", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1.0, 0.0])


def test_shards_and_slots_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    texts = [None, "", "a", "\x00\r\n", "žluť 漢字 🙂 " * 40, "x" * 70000]
    rows = [(None if i % 50 == 0 else 7 if i % 3 else i - 200, rng.choice(texts), "en", "a", 1) for i in range(600)]
    spark.createDataFrame(rows + rows[:90], DOCS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op3_rendezvous_shards(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) == 690 and Counter(got) == Counter(con.execute(queries.OP3_SQL).fetchall())


def test_slots_follow_an_order_beside_columns_of_clashing_names(spark):
    table = spark.range(0, 3000, 1, 9).select((F.col("id") * 7919 % 3000).alias("n"), F.when(F.col("id") % 3 > 0, "big").alias("shard"), F.lit("mine").alias("part"), F.lit(1).alias("_AT"), F.lit(2).alias("at"))
    rows = sharding.gapless(Workspace(spark), table, "shard", "slot", ["n"])
    assert rows.columns == [*table.columns, "slot"]
    for group in ("big", None):
        own = sorted((r["slot"], r["n"], r["part"]) for r in rows.collect() if r["shard"] == group)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {"mine"}
    keys = spark.range(500).select("id", F.col("id").cast("int").alias("i"))
    both = sharding.shard(sharding.shard(keys, "id", [1.0, 2.0, 4.0], "a"), "i", [1.0, 2.0, 4.0], "b")
    assert both.where("a <> b").count() == 0


def test_word_count(spark):
    rows = [("",), (None,), (" ",), ("a",), (" a b\n",), ("a\x0b\x0cb c  d",), ("é\r\n",)]
    for r in spark.createDataFrame(rows, "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect():
        assert r["n"] == len(WORD.findall(r["t"] or ""))


def plain_targets(sizes, weights, budget, cap):
    total, open_ = sum(sizes.values()) * budget, dict(weights)
    out = {}
    while open_:
        level = total / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: w * level for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
            del open_[s]
    return out


def test_targets_and_taken_words(spark, docs, empty):
    df = docs.withColumn("size", mixing.word_count(F.col("text")))
    rows = mixing.repetitions(Workspace(spark), df, "doc_id", "source", F.col("size")).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["times"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["times"] <= 2
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = plain_targets(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 1.5, 2)
    got = {r["source"]: r["target"] for r in rows}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in names)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    again = mixing.repetitions(Workspace(spark), df.repartition(5), "doc_id", "source", F.col("size")).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["times"])
    assert sorted(map(key, again)) == sorted(map(key, rows))
    more = docs.withColumn("target", F.lit("x"))
    mixed = mixing.mix(Workspace(spark), more)
    assert mixed.columns == more.columns and mixed.count() == sum(r["times"] for r in rows)
    assert mixing.mix(Workspace(spark), empty).count() == 0


def test_mix_with_one_key_for_most_rows_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(21)
    rows = [(7 if i % 3 else (None if i % 2 else i), " ".join("w" for _ in range(rng.choice([0, 1, 5, 5, 40]))) or None, "en", [None, "a", "b"][i % 7 % 3], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "s").mkdir()
    got = Counter(tuple(r) for r in queries.op4_water_filling_mix(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP4_SQL})").fetchall()
    assert got == Counter(want)


# ---- 5


def test_main_text():
    page = """<html><head><title>T</title><style>p{x:"</p>"}</style></head><body><nav><ul><li><a href="/a>b">menu</a></ul></nav>
    <div class="ad banner">buy</div><!-- <p>no</p> --><article><h1>Head &amp; more</h1><p><b>One   two.<br><p>Three&nbsp;&#233;</p>x
    <script>var t="</p><p>no";</script><div id="comments"><p>reader</p><div>says</div></div><p>Short.</p></article><footer>&copy;</footer>"""
    assert html_text.main_text(page) == "Head & more\n\nOne two.\n\nThree é\n\nx\n\nShort."
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<nav>x</nav>", "< b", "plain text")] == ["", "", "", "", "< b", "plain text"]
    long = "Words that go on for a while, in a sentence of an article. " * 4
    plain = f"<body><div class=menu><a href=1>one</a></div><p>{long}</p><p>ok.</p><p>{long}</p><form>q</form><aside>side</aside><div><a href=2>link link</a></div>"
    assert html_text.main_text(plain) == "\n\n".join([" ".join(long.split()), "ok.", " ".join(long.split())])


def test_pages_without_an_article_keep_short_text():
    long, menu = " ".join(["word"] * 160), "<nav><p>a</p><p>b</p><p>c</p><p>d</p></nav>"
    assert html_text.main_text(f"<h1>Title</h1>{menu}<p>{long}</p>") == f"Title\n\n{long}"
    parts = ["Title", "By me", "A date", long, long, "End", "Short.", "Shorter."]
    page = "".join(f"<p>{x}</p>" for x in parts[:4]) + '<div class="widget"><p>x</p><p>y</p><p>z</p></div>' + "".join(f"<p>{x}</p>" for x in parts[4:])
    assert html_text.main_text(page) == "\n\n".join(parts)
    small = " ".join(["word"] * 10)  # beyond the edges of the text, and with a tenth of its weight
    assert html_text.main_text(f"<p>{small}</p>{menu}<p>{long}</p>{menu}<p>{small}</p>") == long
    assert html_text.main_text(f"<p>{long}</p>{menu}<p>{small}</p>{menu}<p>{long}</p>") == f"{long}\n\n{small}\n\n{long}"


def test_pages_of_a_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>x</p></article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("x", 1), ("x", 1)]


# ---- 6


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vecs = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.1, 0.2)] + [base[0] * 3, base[0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [None]), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0]), (None, rows[0][1]), (906, [float("inf")] + [1.0] * 15)]
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    lab = np.arange(len(x))
    for _ in range(len(x)):
        lab = np.minimum(lab, np.where(near, lab[None], 10**9).min(axis=1))
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("n", F.lit(1))
    for chunk in (1024, 7):
        monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
        got = {r["key"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(Workspace(spark), df, "vec_id", "embedding").collect()}
        assert all(got[i] == (near[i].sum(), lab[i]) for i in range(len(x)))
        assert got[None] == (0, None) and all(got[i] == (0, i) for i, _ in odd if i is not None)
    assert embed_dedup.near_duplicates(Workspace(spark), df.where("vec_id < 0"), "vec_id", "embedding").count() == 0


# ---- 7, 9

ODD = ["", None, "  a", "a  b\n\n c \t", "it's 's don't'", "12,5 %% a1b2 ..\nx", "\x1c a\x1cb\x85c d　e", "<|endoftext|> x", "a b<|endoftext|>c <|startoftext|>\nd", "<|ENDOFTEXT|>", "a <| b", "日本 語。ok!", "á b. ́x", "ΑΣ ΟΔΟΣ,", "\r\n x \r", "\n", "a\nb", " ", "É ÀÉß ÿ", "a | b||c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name, monkeypatch):
    rng = random.Random(4)
    rows = ODD + ["".join(rng.choice("ab Zé'\n\t.,1$ ́") for _ in range(rng.randrange(60))) for _ in range(400)]
    monkeypatch.setattr(token_ids, "MOST", 50)
    monkeypatch.setattr(token_ids, "BLOCK", 500)
    e, plain = token_ids.Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    for i, ids in e.rows(pa.array(rows), 1):
        want = plain.encode(rows[i] or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(ids, "<u4").tolist() == want, rows[i]


def test_tasks_before_packing_give_up_encoders_of_their_worker(spark, docs, monkeypatch):
    path, tasks, plain = tokenizer_path("byte_bpe_50k.json"), [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    quality_cnn.classify(docs, quality_cnn.constant(None))
    quality_cnn.filter_docs(docs, quality_cnn.constant(None))
    quality_rules.table(docs, "doc_id", "text", None)
    quality_rules.filter_docs(docs, None)
    minhash_dedup.near_duplicates(Workspace(spark), docs, "doc_id", "text")
    assert len(tasks) >= 7
    for task in tasks:
        e = token_ids.encoder(path)
        ids = {t: e.by_chunks(t) for t in ("a b, c", " d")}
        memory = weakref.ref(e.pieces)
        assert memory() and len(e.pieces) >= 4
        del e
        assert list(task(iter([]))) == [] and memory() is None
        assert ids == {t: token_ids.encoder(path).by_chunks(t) for t in ids}


def test_byte_level_pieces_are_remembered_once():
    e = token_ids.Encoder(tokenizer_path("byte_bpe_50k.json"))
    list(e.rows(pa.array(["start word word, word"]), 1))
    assert [*vars(e).values()].count(e.pieces) == sum(isinstance(x, token_ids.Memory) for x in vars(e).values()) == 1
    assert list(e.pieces).count(" word") == 1 and "word" not in e.pieces


def test_records_round_trip_and_notice_damage(spark, docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    ws = Workspace(spark)
    files = ws.path("records")
    token_records.write_records(docs.repartition(3), "doc_id", "text", path, files)
    got = token_records.with_starts(token_records.index_records(ws, files)).orderBy("start").collect()
    e = token_ids.Encoder(path)
    want = sorted(((r["doc_id"], e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["key"] for r in got] == [k for k, _ in want]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want)
    data = token_records.frame(-5, np.array([1, 70000], "<u4").tobytes()) + b"\n" + token_records.frame(None, b"") + b"\n"
    key, ids, at = token_records.parse(data)
    assert (key, ids.tolist()) == (-5, [1, 70000]) and token_records.parse(data, at)[0] is None
    for i in (3, 9, 14, len(data) // 2):
        with pytest.raises(ValueError):
            bad = bytearray(data)
            bad[i] ^= 1
            token_records.parse(bytes(bad))
            token_records.parse(bytes(bad), at)
    files = ws.path("records")
    token_records.write_records(empty, "doc_id", "text", path, files)
    assert token_records.index_records(ws, files).count() == 0


def test_record_files_are_bounded_in_bytes(spark):
    path, ws = tokenizer_path("word_bpe_49k.json"), Workspace(spark)
    files = ws.path("records")
    docs = spark.range(70).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', if(id = 5, 1200000, 20000))").alias("text"))
    token_records.write_records(docs.coalesce(1), "doc_id", "text", path, files)
    index = token_records.with_starts(token_records.index_records(ws, files)).orderBy("start").collect()
    size = sorted(r["length"] for r in spark.read.format("binaryFile").load(files).drop("content").collect())
    assert len(size) > 5 and size[-2] <= 1 << 20 < size[-1]  # the long text's record is a file of its own
    assert [r["key"] for r in index] == list(range(70))
    assert [r["start"] for r in index] == np.cumsum([0, *(r["n_tokens"] for r in index[:-1])]).tolist()


def check_packing(rows, want, width=2048):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    padding = 0
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    for k, ids in want.items():
        parts = sorted(pieces[k], key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids) and {r["doc_tokens"] for r in parts} == {len(ids)}
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    return padding


def test_packing_keeps_every_id(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    e = token_ids.Encoder(path)
    single = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in single.collect()}
    rows = packing.pack(single.repartition(3), "doc_id", "text", path).collect()
    assert check_packing(rows, want) == 0
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(empty, "doc_id", "text", path).count() == 0
    assert packing.pack(docs, "doc_id", "text", path, ids=False).agg(F.sum("length")).first()[0] == sum(len(e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(6)
    p = packing.Packer(width=32)
    for i in range(2000):
        size = rng.randrange(1, 32)
        n = p.count.copy()

        def cost(level, size=size, n=n):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 32:
                m[level + size] += 1
            return (m[1:32] ** 2).sum()

        options = [0] + [x for x in range(1, 32 - size + 1) if n[x]]
        best = min(cost(x) for x in options)
        level = p.level(size)
        assert level in options and cost(level) == best and level == max(x for x in options if cost(x) == best)
        p.add(i, struct.pack("<I", 7) * size)
    p.finish()
    assert all(sum(len(x[2]) for x in w) // 4 <= 32 for w in p.closed)


def test_windows_that_nothing_fills_are_handed_on(spark, monkeypatch):
    """Lengths that don't combine, with room for few open windows: all ids stay, nothing is padded."""
    monkeypatch.setattr(packing, "OPEN", 5000)
    path = tokenizer_path("byte_bpe_50k.json")
    e = token_ids.Encoder(path)
    rows = [(i, "word " * (1100 + i % 3)) for i in range(60)] + [(100, "a b c")]
    want = {k: e.tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "doc_id", "text", path).collect()
    assert check_packing(got, want) == 0
    assert any(r["sequence_id"] >= packing.AFTER << 33 for r in got)


def test_few_windows_are_filled_up_with_cuts():
    """Of documents that fit a window few are cut, however many partitions they come in."""
    rng = random.Random(3)
    sizes = [min(2047, int(rng.lognormvariate(5.8, 1))) + 1 for _ in range(8000)]
    left, full = [], 0
    for part in range(8):
        p = packing.Packer()
        for i in range(part, len(sizes), 8):
            p.add(i, bytes(4 * sizes[i]))
        full += len(p.closed)
        left += p.leave()
    p = packing.Packer()
    for piece in sorted(left, key=lambda x: -len(x[2])):
        p.join(piece)
    full, before = full + len(p.closed), len(p.closed)
    p.finish()
    assert len(p.closed) - before < 0.07 * (full + len(p.closed) - before)
    pieces = Counter(x[0] for w in p.closed for x in w)
    assert sum(n > 1 for n in pieces.values()) < 0.02 * len(sizes)


# ---- 8


def test_language_model_counts_and_proper_codes(spark, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["The", "the", "of", "cat", "dog", "runs"]) + (str(rng.randrange(4)) if rng.random() < 0.1 else "") for _ in range(rng.randrange(1, 90))), "en", "s", 1) for i in range(150)]
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (502, "never seen wörds", "en", "s", 1), rows[3], (None, "the of", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    held = labelled.fold(F.col("doc_id"), 10) == 0
    got = lm_mixing.score(Workspace(spark), docs, "doc_id", "text", held).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tok = lambda t: WORD.findall((t or "").translate(low)) + [None]
    is_held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, t, *_ in rows if not is_held(i) for x in tok(t))
    n, v = sum(c.values()), len(c)
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = tok(text[r["key"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(r["key"]), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9) and r["score"] < 0
    assert lm_mixing.score(Workspace(spark), empty, "doc_id", "text", held).count() == 0


def learnt(spark, rows):
    """(model, blocks of all rows) of texts that are all training ones."""
    docs = spark.createDataFrame(rows, DOCS)
    ws = Workspace(spark)
    model = lm_mixing.learn(ws, docs.select("text"))
    work = lm_mixing.coded(ws, docs, model, "doc_id", "text", F.lit(False))
    counts = lm_mixing.class_counts(ws, work, model.size)
    model.tables = lm_mixing.tables_of(model, counts)
    return model, [bytes(r["data"]) for r in work.where("block IS NOT NULL").select("data").collect()], counts


def answered(model, blocks, which):
    """What the shards say of one block's keys."""
    chunks = defaultdict(list)
    for i, data in enumerate(blocks):
        for shard, keys in lm_mixing.asked(model, data):
            chunks[shard].append((i, keys))
    out = []
    for shard in sorted(chunks):
        for (i, _), told in zip(chunks[shard], lm_mixing.served([k for _, k in chunks[shard]]), strict=True):
            if i == which:
                out.append((shard, told))
    return out


def test_everything_that_is_counted_grows_with_the_training_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "SHARD", 8)
    rng = random.Random(4)
    rows = [(7 if i % 3 == 0 else i, prose(rng, rng.choice([5, 60, 200])), "en", "s", 1) for i in range(60)] + [(900, None, None, None, None)]
    model, blocks, counts = learnt(spark, rows)
    total = sum(len(WORD.findall(t or "")) + 1 for _, t, *_ in rows)
    assert model.n == total and model.shards == total >> 8 > 1
    assert all(c.sum() == total for c in counts)
    asked = [lm_mixing.unpack_keys(k) for data in blocks for shard, k in lm_mixing.asked(model, data) if shard < model.shards]
    assert sum(times.sum() for _, times in asked) == total


def test_keys_travel_and_come_back_counted():
    rng = np.random.default_rng(0)
    chunks, want = [], Counter()
    for _ in range(4):
        keys = np.unique(rng.integers(0, 1 << lm_mixing.KEY_BITS, 300, dtype=np.uint64) & np.uint64(0xFFF00C000F0))
        times = rng.integers(0, 1000, len(keys))
        chunks.append(lm_mixing.pack_keys(keys, times))
        back = lm_mixing.unpack_keys(chunks[-1])
        assert (back[0] == keys).all() and (back[1] == times).all()
        want.update(dict(zip(keys.tolist(), times.tolist(), strict=True)))
    contexts = Counter()
    for k, n in want.items():
        contexts[k >> lm_mixing.SYMBOL_BITS] += n
    for data, told in zip(chunks, lm_mixing.served(chunks), strict=True):
        keys = lm_mixing.unpack_keys(data)[0].tolist()
        c, n = lm_mixing.unpack(told, "<u4 <u4")
        assert c.tolist() == [want[k] for k in keys] and n.tolist() == [contexts[k >> lm_mixing.SYMBOL_BITS] for k in keys]
    wide = np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    assert (lm_mixing.unpack_keys(lm_mixing.pack_keys(wide, np.ones(50, int), True))[0] == wide).all()


def ready(rows, held=1):
    """A block of rows of symbols."""
    sizes = np.array([len(r) for r in rows], "<u4")
    n = np.zeros(len(rows), "<i8")
    return lm_mixing.pack(n, n.astype("u1"), np.full(len(rows), held, "u1"), n, sizes, np.concatenate(rows).astype("<i4"), np.zeros(0, "<u8"), np.zeros(0, "<f4"))


def test_probabilities_of_the_whole_model_sum_to_one(spark):
    rng = random.Random(9)
    phrase = "the cat sat on the mat and the dog ran".split()
    rows = [(i, " ".join(rng.choice(phrase) for _ in range(30)) + " " + " ".join(phrase), "en", "s", 1) for i in range(40)]
    model, blocks, _ = learnt(spark, rows)
    h = lm_mixing.tokens(*next(texts.blocks(pa.array([" ".join(phrase)])))[1:])[0]
    s = model.symbols(h)
    for k in (0, 1, 5, 9):
        after = [np.append(s[:k], x) for x in range(model.size)] + ([s[:k]] if k else [])
        # slots are scored as symbols here: words of a slot share its probability
        monkey = ready(after)
        got = np.array(_scores_of_symbols(model, [*blocks, monkey]))
        p = 10 ** (got[: model.size] - (got[-1] if k else 0))
        assert abs(p.sum() - 1) < 1e-6
        assert k < 5 or p[s[k]] > 0.3  # a context that was seen makes the word that followed likely


def _scores_of_symbols(model, blocks):
    top, model.top = model.top, np.arange(model.size)  # no symbol counts as rare
    base, model.base = model.base, np.zeros(model.size)
    try:
        return lm_mixing.scored_block(model, blocks[-1], answered_by_places(model, blocks)).column("score").to_pylist()
    finally:
        model.top, model.base = top, base


def answered_by_places(model, blocks):
    return [(shard, told) for shard, told in answered(model, blocks, len(blocks) - 1) if shard < model.shards]


def pathed(model, blocks, which):
    """As answered_by_places, with the counts at inner nodes."""
    chunks = defaultdict(list)
    for i, data in enumerate(blocks):
        for shard, keys in lm_mixing.asked(model, data):
            if shard < model.shards:
                chunks[shard].append((i, keys))
    return [(shard, told) for shard in sorted(chunks) for (i, _), told in zip(chunks[shard], lm_mixing.served([k for _, k in chunks[shard]], model), strict=True) if i == which]


def test_hashed_contexts_count_at_every_node(spark):
    rng = random.Random(4)
    model, blocks, _ = learnt(spark, [(i, " ".join(rng.choice("abcdefg") for _ in range(40)), "en", "s", 1) for i in range(30)])
    code, place, _ = model.codes()
    for i, data in enumerate(blocks):
        keys = [lm_mixing.unpack_keys(k) for shard, k in lm_mixing.asked(model, data) if shard < model.shards]
        every = Counter()
        for other in blocks:
            for shard, k in lm_mixing.asked(model, other):
                if shard < model.shards:
                    for key, n in zip(*(x.tolist() for x in lm_mixing.unpack_keys(k)), strict=True):
                        every[shard, key >> lm_mixing.SYMBOL_BITS, key & ((1 << lm_mixing.SYMBOL_BITS) - 1)] += n
        bits = lambda x: model.bit[model.first[x] : model.first[x + 1]].tolist()
        for (shard, told), (own, _) in zip(pathed(model, blocks, i), keys, strict=True):
            c, n, many, counts = lm_mixing.unpack(told, "<u4 <u4 u1 <u4")
            at = np.cumsum(many.astype(int)) - many
            for j, key in enumerate(own.tolist()):
                context, x = key >> lm_mixing.SYMBOL_BITS, key & ((1 << lm_mixing.SYMBOL_BITS) - 1)
                b = bits(x)
                want = [sum(m for (sh, ctx, y), m in every.items() if (sh, ctx) == (shard, context) and bits(y)[:d] == b[:d]) for d in range(1, len(b) + 1)]
                assert [*counts[at[j] : at[j] + many[j]].tolist(), *[c[j]] * (len(b) - many[j])] == want


def test_hashed_contexts_leave_out_their_own_row(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(60)), "en", "s", 1) for i in range(12)]
    model, blocks, _ = learnt(spark, rows)
    scored = lambda m, b: {r["key"]: r["score"] for i in range(len(b)) for r in lm_mixing.scored_block(m, b[i], pathed(m, b, i)).to_pylist()}
    whole = scored(model, blocks)
    _, no_key, _, *rest = lm_mixing.unpack(blocks[0], lm_mixing.BLOCK_KINDS)
    key = lm_mixing.unpack(blocks[0], lm_mixing.BLOCK_KINDS)[0]
    for k in key.tolist()[:3]:
        out = [lm_mixing.pack(key, no_key, (key == k).astype("u1"), *rest), *[b for b in blocks[1:]]]
        assert math.isclose(scored(model, out)[k], whole[k], rel_tol=1e-6)  # held out, its counts are not there at all


def test_hashed_contexts_mix_to_a_distribution(spark):
    rng = random.Random(9)
    phrase = "the cat sat on the mat and the dog ran".split()
    model, blocks, _ = learnt(spark, [(i, " ".join(rng.choice(phrase) for _ in range(30)) + " " + " ".join(phrase), "en", "s", 1) for i in range(40)])
    s = model.symbols(lm_mixing.tokens(*next(texts.blocks(pa.array([" ".join(phrase)])))[1:])[0])
    for k in (0, 1, 5, 9):
        every = [*blocks, ready([np.append(s[:k], x) for x in range(model.size)] + ([s[:k]] if k else []))]
        top, model.top, base, model.base = model.top, np.arange(model.size), model.base, np.zeros(model.size)
        answers = pathed(model, every, len(every) - 1)
        assert any(lm_mixing.unpack(x, "<u4 <u4 u1 <u4")[2].any() for _, x in answers) or k < 1
        got = np.array(lm_mixing.scored_block(model, every[-1], answers).column("score").to_pylist())
        model.top, model.base = top, base
        assert abs((10 ** (got[: model.size] - (got[-1] if k else 0))).sum() - 1) < 1e-6


def test_spellings_are_a_distribution(spark):
    rng = random.Random(3)
    model, _, _ = learnt(spark, [(i, prose(rng, 80), "en", "s", 1) for i in range(20)])
    every = np.arange(256)
    for context in (32 * 256 + 32, 32 * 256 + ord("a"), ord("b") * 256 + ord("c"), 5 * 256 + 7):
        assert abs(model.byte(np.full(256, context), every).sum() - 1) < 1e-9
    assert model.slot_p.sum() <= 1 + 1e-6
    words = ["".join(x) for n in (1, 2) for x in __import__("itertools").product("abcde", repeat=n)]
    data, starts = next(texts.blocks(pa.array([" ".join(words)])))[1:]
    at = texts.Words(data, starts)
    slot = lm_mixing.slot_of(data[at.start], np.where(at.end - at.start > 1, data[np.minimum(at.start + 1, len(data) - 1)], 32))
    assert max(np.bincount(slot, 10 ** model.spelled(data, at.start, at.end))) <= 1 + 1e-6


def test_a_text_that_comes_in_parts_scores_alike(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 400), "en", "s", 1) for i in range(6)]
    rows.append((10, rows[0][1] + " " + rows[1][1] * 3, "en", "s", 1))
    model, blocks, _ = learnt(spark, rows)
    whole = [lm_mixing.scored_block(model, b, answered(model, blocks, i)).column("score").to_pylist() for i, b in enumerate(blocks)]
    monkeypatch.setattr(lm_mixing, "PART", 2 * lm_mixing.STEP)
    parts = [lm_mixing.scored_block(model, b, answered(model, blocks, i)).column("score").to_pylist() for i, b in enumerate(blocks)]
    assert np.allclose(sum(whole, []), sum(parts, []), rtol=1e-4)


def test_steps_weigh_only_rows_that_go_on(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, n), "en", "s", 1) for i, n in enumerate((137, 100, 20, 3000, 5, 64, 300, *[10] * 30))]
    model, blocks, _ = learnt(spark, rows)
    answers = [answered(model, blocks, i) for i in range(len(blocks))]
    bins, real = [], np.bincount
    with monkeypatch.context() as m:
        m.setattr(lm_mixing.np, "bincount", lambda x, weights=None, minlength=0: (bins.append(minlength), real(x, weights, minlength))[1])
        whole = [lm_mixing.scored_block(model, b, a).column("score").to_pylist() for b, a in zip(blocks, answers, strict=True)]
    of_rows = sum(-(-(len(r[1].split()) + 1) // lm_mixing.STEP) for r in rows)
    assert sum(bins) < 6 * of_rows * lm_mixing._GATES + 10 * len(rows) * len(blocks)  # not each step's times all rows
    monkeypatch.setattr(lm_mixing, "PART", 2 * lm_mixing.STEP)  # ends of texts come with longer ones, in any order
    parts = [lm_mixing.scored_block(model, b, a).column("score").to_pylist() for b, a in zip(blocks, answers, strict=True)]
    assert np.allclose(sum(whole, []), sum(parts, []), rtol=1e-4)


def test_copies_are_told_from_other_texts(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 150), "en", "s", 1) for i in range(60)] + [(100 + i, None, "en", "s", 1) for i in range(2)]
    rows[60:] = [(100 + i, rows[i][1], "en", "s", 1) for i in range(4)]
    got = {r["key"]: r["bits_per_byte"] for r in lm_mixing.score(Workspace(spark), spark.createDataFrame(rows, DOCS), "doc_id", "text", F.lit(False)).collect()}
    copies = [got[i] for i in (*range(4), *range(100, 104))]
    assert max(copies) < 0.3 * min(v for k, v in got.items() if 4 <= k < 60)


def test_codes_are_a_distribution():
    rng = np.random.default_rng(2)
    for n in (2, 3, 50):
        w = rng.integers(1, 100, n)
        first, node, bit, share = lm_mixing.huffman(w)
        p = [np.prod([share[node[k]] if bit[k] else 1 - share[node[k]] for k in range(first[s], first[s + 1])]) for s in range(n)]
        assert np.allclose(p, w / w.sum())


# ---- 10


def plain_components(rows, percent):
    sets, up = {}, {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash_against_brute_force(spark, docs, empty, monkeypatch):
    rows = [r for r in corpus() if r[0] is not None]
    chain = random.Random(9)
    w = prose(chain, 150).split(" ")
    for i in range(40):
        w = list(w)
        w[chain.randrange(150)] = f"q{i}"
        rows.append((3000 + i, " ".join(w), "en", "s", 1))
    table = spark.createDataFrame(rows, DOCS).unionByName(docs.where("doc_id IS NULL")).withColumn("sig", F.lit(1))
    for chunk, percent in ((512, 85), (5, 80)):
        monkeypatch.setattr(minhash_dedup, "CHUNK", chunk)
        want = plain_components(rows, percent)
        got = minhash_dedup.near_duplicates(Workspace(spark), table, "doc_id", "text", percent).collect()
        assert len(got) == len(rows) + 2
        assert all((r["n_shingles"], r["component_id"]) == want[r["key"]] for r in got if r["key"] is not None)
        assert all(r["component_id"] is None for r in got if r["key"] is None)
    assert minhash_dedup.near_duplicates(Workspace(spark), empty, "doc_id", "text").count() == 0


def test_key_with_several_texts_joins_their_links(spark):
    rng = random.Random(3)
    made = [prose(rng, 120) for _ in range(12)]
    near = [x.split(" ") for x in made]
    for w in near:
        w[60] = "other"
    rows = [(5, x) for x in made] + [(10 + i, " ".join(w)) for i, w in enumerate(near)] + [(90, prose(rng, 120))]
    got = minhash_dedup.near_duplicates(Workspace(spark), spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 85).collect()
    assert len(got) == len(rows)
    assert {r["key"]: r["component_id"] for r in got} == {5: 5, **{10 + i: 5 for i in range(12)}, 90: 90}
