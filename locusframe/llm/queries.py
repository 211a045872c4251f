"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embed_dedup, fill_middle, html_text, language_id, lm_mixing, minhash_dedup, mixing, packing, quality_cnn, quality_rules, sharding, token_records
from .labelled import fold
from .shared import Workspace

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = quality_cnn.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_cnn.classify(docs, network)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.rules(docs, trees).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "score")


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.shard(docs, "doc_id", [1.0] * SHARDS)
    placed = sharding.shard(placed, "doc_id", [1.0] * (SHARDS + 1), out="grown_shard")
    ws = Workspace(spark)
    out = sharding.gapless(ws, ws.keep(placed, "placed"), "shard", "slot", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.repetitions(Workspace(spark), docs, "doc_id", "source", F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files of public tokenizers lie; they are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    files = ws.path("records")
    token_records.write_records(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"), files)
    index = token_records.with_starts(token_records.index_records(ws, files))
    return index.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_mixing.score(Workspace(spark), _table(spark, sf_dir, "documents"), "doc_id", "text", fold(F.col("doc_id"), 10) == 0)
    return out.withColumnRenamed("key", "doc_id")


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), ids=False)


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_sign_hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed_dedup.near_duplicates(Workspace(spark), _table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.95)
    return out.select(F.col("key").alias("vec_id"), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op10_minhash_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(Workspace(spark), _table(spark, sf_dir, "documents"), "doc_id", "text", percent=85)
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op11_kneser_ney_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = language_id.train(docs, fold(F.col("doc_id"), 4) != 2)
    out = language_id.identify(docs, known)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "bits_per_char", "rejected")


def op12_marker_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id",
        F.col("units").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster(Workspace(spark), _table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return centroids.summed_up(assigned.withColumnRenamed("key", "vec_id"), found)


def _crc32_sql(data: str) -> str:
    """CRC-32 of a BLOB, byte by byte: eight steps of the register at once are a sum, without carry, of those of the eight bits."""
    step = "a >> 8"
    for bit in range(8):
        register = 1 << bit
        for _ in range(8):
            register = register >> 1 ^ (0xEDB88320 if register & 1 else 0)
        step = f"xor({step}, ((xor(a, b) >> {bit}) & 1) * {register})"
    values = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}, {values}), lambda a, b: {step}), {0xFFFFFFFF})"


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32_sql("encode(coalesce(text, ''))")} AS text_crc32,
         md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (SELECT doc_id, size, text_crc32, CAST('0x' || h[1:8] AS BIGINT) % {sharding.PRIME} AS a, CAST('0x' || h[9:16] AS BIGINT) % {sharding.PRIME} AS b FROM d),
x AS (SELECT doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda s: (a + b * (s + 1)) % {sharding.PRIME}) AS x FROM k),
y AS (SELECT *, list_transform(x, lambda v, i: (v * 48271 + i - 1) % {sharding.PRIME}) AS y FROM x),
z AS (SELECT *, list_transform(y, lambda v, i: ((v * v + v * 7 + 13) % {sharding.PRIME} * 69621 + x[i]) % {sharding.PRIME}) AS z FROM y),
s AS (SELECT doc_id, size, text_crc32, list_position(z[1:{SHARDS}], list_max(z[1:{SHARDS}])) - 1 AS shard, list_position(z, list_max(z)) - 1 AS grown_shard FROM z)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM s
"""

OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ((coalesce(doc_id, 0) % 2147483647) + 2147483647) % 2147483647 AS a
  FROM documents
), ranked AS (
  SELECT doc_id, source, size, (c * 69621 + a + 17) % 2147483647 AS rank FROM (
    SELECT *, (b * b + b * 7 + 13) % 2147483647 AS c FROM (SELECT *, (a * 48271 + 11) % 2147483647 AS b FROM sized))
), sources AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
    FROM sized GROUP BY source)
), levels AS (
  SELECT *, row_number() OVER o AS pos,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM sources WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), goals AS (
  SELECT source, source_size, CASE WHEN pos >= f THEN least(weight * lam, cap) ELSE cap END AS target FROM (
    SELECT l.*, min(pos) FILTER (weight * level <= cap) OVER () AS f, min_by(level, pos) FILTER (weight * level <= cap) OVER () AS lam FROM levels l)
), parts AS (
  SELECT source, source_size, target, w, target - w * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS w FROM goals)
), placed AS (
  SELECT doc_id, source, size, 2 * coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ASC NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS mid FROM ranked
)
SELECT doc_id, size, source_size, target,
       CAST(size * (w + CASE WHEN mid < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed JOIN parts ON placed.source IS NOT DISTINCT FROM parts.source
"""

OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS whole, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), units AS (
  SELECT doc_id, whole, regexp_extract_all(whole, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
         CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM hashed
), cut AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS prefix, coalesce(array_to_string(u[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(u[high + 1:], ''), '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE whole END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM parts
"""


def _op13_sql(clusters: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Rounds of a full search, one after the other; rows are numbered, as keys may repeat."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (
    SELECT v, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {clusters})
)"""]  # fmt: skip
    assign = """a{r} AS MATERIALIZED (
  SELECT row, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT row, vec_id, v, cluster, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)]) AS BIGINT) AS d FROM kept, c{r})
  GROUP BY row, vec_id, v
)"""
    update = """c{n} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster) m ON m.cluster = c{r}.cluster
)"""
    for r in range(rounds):
        steps += [assign.format(r=r), update.format(r=r, n=r + 1)]
    steps.append(assign.format(r=rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_network": op1_byte_network,
    "op2_tree_rules": op2_tree_rules,
    "op3_rendezvous_shards": op3_rendezvous_shards,
    "op4_water_filling_mix": op4_water_filling_mix,
    "op5_line_blocks": op5_line_blocks,
    "op6_sign_hash_embeddings": op6_sign_hash_embeddings,
    "op7_token_records": op7_token_records,
    "op8_context_mixing": op8_context_mixing,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_minhash_coordinate_join": op10_minhash_coordinate_join,
    "op11_kneser_ney_languages": op11_kneser_ney_languages,
    "op12_marker_fill_middle": op12_marker_fill_middle,
    "op13_sort_means": op13_sort_means,
}

SQL: dict[str, str] = {"op3_rendezvous_shards": OP3_SQL, "op4_water_filling_mix": OP4_SQL, "op12_marker_fill_middle": OP12_SQL, "op13_sort_means": _op13_sql()}
