"""Language identification, fill-in-middle and centroid clustering against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import centroids, fill_middle, language_id, queries
from locusframe.llm.shared import Workspace

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def crc(x):
    return zlib.crc32(str(x).encode())


# ---- language identification


def plain(text):
    """Letters in lower case, all else one space; then what each row is led by."""
    out = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text)).strip()
    return " " * (language_id.ORDER - 1) + (out + " " if out else "")


class Slow:
    """Interpolated Kneser-Ney by dictionaries, as the formula has it."""

    def __init__(self, texts):
        n = language_id.ORDER
        counts = {n: Counter(p[i - n + 1 : i + 1] for p in map(plain, texts) for i in range(n - 1, len(p)))}
        for k in range(n - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.total, self.kinds, self.discount = counts, {}, {}, {}
        for k, own in counts.items():
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, c in own.items():
                self.total[k][g[:-1]] += c
                self.kinds[k][g[:-1]] += 1
            once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
            self.discount[k] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    def p(self, gram, k=language_id.ORDER):
        if k == 0:
            return 1 / language_id.ALPHABET
        own, context, low = gram[-k:], gram[-k:-1], self.p(gram, k - 1)
        if not self.total[k][context]:
            return low
        d = self.discount[k]
        return (max(self.counts[k][own] - d, 0) + d * self.kinds[k][context] * low) / self.total[k][context]

    def bits(self, text):
        x, n = plain(text), language_id.ORDER
        return -sum(math.log2(self.p(x[i - n + 1 : i + 1])) for i in range(n - 1, len(x))) / (len(x) - n + 1)


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


TONGUES = {"aa": "abcdeé", "bb": "efghij", "cc": "aeioußn"}


def speech(seed=3, n=120):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = list(TONGUES)[i % 3]
        rows.append((i, words(rng, TONGUES[lang], rng.choice([4, 30, 200])), lang, "s", 1))
    return rows


def test_model_is_kneser_ney_as_by_its_formula():
    rng = random.Random(1)
    texts = [words(rng, "abcdeé", 60) for _ in range(12)] + ["", "X-y, 9 Zz!"]
    chars, first, has = language_id.characters(*language_id._block(texts))
    assert list(has) == [bool(re.search(r"[^\W\d_]", t)) for t in texts]
    model, slow = language_id.fit(chars, first), Slow(texts)
    asked = [words(rng, "abcdxé", 30), "q", "ab", texts[0], "É è", words(rng, "abcdeé", 3000)]
    ident = language_id.Identifier(["aa"], [model])
    bits, n = ident.entropies(*language_id._block(asked))
    assert np.allclose(bits[:, 0], [slow.bits(t) for t in asked], rtol=1e-5)
    assert list(n) == [len(plain(t)) - language_id.ORDER + 1 for t in asked]
    for context in ("    ", "  ab", "abcd", "qqqq"):  # shares of a context sum to 1 over the alphabet
        letters = {g[-1] for g in slow.counts[1]}
        assert abs(sum(slow.p(context + c) for c in letters) + (language_id.ALPHABET - len(letters)) * slow.p(context + "\U0001f600") - 1) < 1e-9


def test_stretches_and_blocks_do_not_change_results(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, "abcdeé", k) for k in (1, 50, 700, 2, 90)] + ["", "  ", "!"]
    chars, first, _ = language_id.characters(*language_id._block(texts))
    ident = language_id.Identifier(["aa", "bb"], [language_id.fit(chars, first), language_id.fit(*language_id.characters(*language_id._block(["ab cd"]))[:2])])
    whole = ident.sums(chars, first)
    for stretch in (1, 3, 7, 100):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        assert np.allclose(ident.sums(chars, first), whole)
    alone = np.concatenate([ident.sums(*language_id.characters(*language_id._block([t]))[:2]) for t in texts])
    assert np.allclose(alone, whole)


@pytest.fixture(scope="module")
def spoken(spark):
    long = words(random.Random(9), TONGUES["bb"], 200_000)
    rows = speech() + [(1000, None, "aa", None, None), (1001, "", "bb", None, 0), (1002, " 12 !\n", None, "s", 1), (1003, long, "bb", "s", 1), (1004, "Éé", None, None, 1), (None, words(random.Random(4), TONGUES["cc"], 40), "cc", "s", 1), (1005, words(random.Random(5), "xyzwvu", 60), None, "s", 1)]
    rows += [rows[0]] * 3 + [(1006, words(random.Random(6), TONGUES["aa"], 90), "und", "s", 1)]
    return rows, spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "part": F.lit(0), "hash": F.lit(0)}).repartition(5)


def test_languages_are_told_apart(spoken):
    rows, docs = spoken
    known = language_id.train(docs, F.coalesce(F.col("doc_id") % 4 != 2, F.lit(True)))
    assert known.names == ["aa", "bb", "cc"]
    got = language_id.identify(docs, known).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    right = {r[0]: r[2] for r in rows if r[2] in TONGUES and r[0] is not None}
    held = [(r["lang"] == right[r["doc_id"]], r["score"]) for r in got if r["doc_id"] in right and r["doc_id"] % 4 == 2 and r["doc_id"] < 1000]
    assert sum(x for x, _ in held) / len(held) > 0.95 and all(0 <= s <= 1 for _, s in held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang"] == "bb" and by[1004]["lang"] in TONGUES and by[None]["lang"] == "cc"
    assert by[1005]["rejected"] and not by[1003]["rejected"]  # no language of its letters is known
    assert sum(r["rejected"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000) < 0.06 * len(got)


def test_languages_of_tables_without_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    known = language_id.train(empty, F.lit(True))
    assert known.names == [] and language_id.identify(empty, known).count() == 0
    one = spark.createDataFrame([(1, "abc def", None, None, None), (2, "!", "aa", "s", 1)], DOCS)
    assert {(r["lang"], r["score"], r["rejected"]) for r in language_id.identify(one, language_id.train(one, F.lit(True))).collect()} == {("und", 0.0, True)}


def test_the_sample_is_bounded_and_takes_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_TEXTS", 20)
    monkeypatch.setattr(language_id, "MOST_OF_TEXT", 50)
    rows = [(i, f"text {i} " + "x" * (i % 90), "aa", "s", 1) for i in range(400)] + [(i, "the same", "bb", "s", 1) for i in range(400, 900)]
    got = language_id.sample(spark.createDataFrame(rows, DOCS), F.lit(True)).collect()
    assert Counter(r["lang"] for r in got) == {"aa": 20, "bb": 1} and max(len(r["part"]) for r in got) == 50
    assert len({r["hash"] for r in got}) == 21


def test_op11(spark, spoken, tmp_path):
    rows, docs = spoken
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_kneser_ney_languages(spark, str(tmp_path))
    kinds = {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert {c: dict(got.dtypes)[c] for c in kinds} == kinds
    for r in got.collect():
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 4 == 2)
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("t"))
    hidden.write.parquet(f"{tmp_path}/b/documents.parquet")
    again = queries.op11_kneser_ney_languages(spark, f"{tmp_path}/b")
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], round(r["score"], 9))
    assert sorted(map(key, again.collect())) == sorted(map(key, got.collect()))  # labels of held-out rows and other columns are no inputs


# ---- fill-in-middle


def texts_to_cut():
    rng = random.Random(7)
    mark = fill_middle.MARKER + fill_middle.ESCAPE
    rows = [(i, "".join(rng.choice(["ab", " ", "\n", "é", "😀", "\t ", "m", "e", "$1", "\\", *mark, "\x85", "<"]) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    rows += [(i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<P", "S>", "", None, "   ", " a", "a ", fill_middle.MARKER, fill_middle.ESCAPE + "m", "word"], 300)]
    return rows + [rows[0], rows[0], (None, "no key here"), (400, "long words " * 300_000), (401, "x" * 2_000_000)]


def cut(key, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    units = UNIT.findall(text)
    assert "".join(units) == text
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = texts_to_cut()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, marked int, form string").repartition(3).withColumn("c0", F.lit(5))
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "marked", "c0", "units", "form", "prefix", "middle", "suffix", "output"]
    got = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert (r["units"], r["form"], r["prefix"], r["middle"], r["output"]) == cut(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    assert {r["form"] for r in fill_middle.fill_in_middle(df, share=0).collect()} == {"plain"}


def test_op12(spark, tmp_path):
    rows = texts_to_cut()
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op12_marker_fill_middle(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    want = []
    for key, text in rows:
        n, form, p, m, output = cut(key, text)
        want.append((key, n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(text or "")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert not re.search("Python|Arrow", got._jdf.queryExecution().executedPlan().toString())


# ---- centroid clustering


def slow_clusters(rows, clusters=16, rounds=3, size=64, scale=64):
    kept = [(k, [math.floor(scale * float(np.float32(x))) for x in v]) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:clusters]
    cent = [list(v) for _, v in first]
    for r in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cent)) for _, v in kept]
        if r < rounds:
            groups = defaultdict(list)
            for (_, i), (_, v) in zip(own, kept):
                groups[i].append(v)
            for i, vs in groups.items():
                cent[i] = [sum(col) // len(vs) for col in zip(*vs)]
    per = Counter()
    for d, i in own:
        per[i] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((k, i, d, per[i], sum(per.values()), digest[i]) for (k, _), (d, i) in zip(kept, own)), key=str)


def vectors(seed=5, n=400, size=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, size))
    rows = [(i, (base[i % 12] + rng.normal(size=size) * rng.choice([0.0, 0.2, 1.0])).astype(np.float32).tolist()) for i in range(n)]
    rows += [rows[0]] * 3 + [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * size), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * size), (None, [0.5] * size), (None, [-0.5] * size), (908, [-0.001] * size)]
    return rows


def test_op13(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, cluster int, key string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_sort_means(spark, str(tmp_path))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [dict(got.dtypes)[c] for c in names] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == slow_clusters(rows)


@pytest.mark.parametrize("values", [[], [1], [5] * 40, [0, 1, 2, 3, 4, 5, 6, 7, 8] * 6])
def test_clusters_of_few_equal_and_tied_vectors(spark, values):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate(values)]
    table = spark.createDataFrame(rows, "k bigint, v array<float>")
    got, found = centroids.cluster(Workspace(spark), table, "k", "v", size=2, clusters=4, rounds=3, scale=1)
    got = centroids.summed_up(got, found) if rows else got
    want = slow_clusters(rows, clusters=4, size=2, scale=1)
    assert sorted((tuple(r) for r in got.select("key", "cluster", "distance").collect()), key=str) == [w[:3] for w in want]


def test_stopping_early_finds_the_nearest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        c, x = rng.integers(-3, 4, (9, 2)), rng.integers(-5, 6, (300, 2))
        near, d = centroids.Order(c).assign(x, rng.integers(0, 9, 300))
        every = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (near == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_large_components_are_clamped(spark):
    table = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "k bigint, v array<float>")
    got, _ = centroids.cluster(Workspace(spark), table, "k", "v", size=2, clusters=1, rounds=0)
    assert max(r["distance"] for r in got.collect()) == 2 * centroids.LARGEST**2
