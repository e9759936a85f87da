"""The queries of this subpackage, as the driver calls them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_scores, compression_quality, exact_topk, language_centroids, mixing, packing, perplexity_rules, simhash_golay, token_store, toxicity_kernel
from ._base import fold, table
from ._tokens import tokenizer_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = perplexity_rules.judge(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_centroids.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    r = language_centroids.identify(docs, model)
    return r.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_kernel.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    r = toxicity_kernel.score(docs, model)
    return r.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = backoff_scores.score(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), "n_backed_off")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_quality.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    r = compression_quality.score(docs, model)
    return r.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_path(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_store.read(spark, path, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_toxicity": op4_toxicity,
        "op5_exact_topk": op5_exact_topk,
        "op6_packing": op6_packing,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_mixing": op8_mixing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_token_ids": op10_token_ids,
    }


#: Equal rows for repeated vec_ids aside, which the tables do not have.
OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

#: Order 2, ALPHA 0.4, each text's own n-grams left out.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM d),
p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
n AS (SELECT doc_id, v, w,
             count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
             count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
             count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS t FROM p),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w), o AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY doc_id, w),
s AS (SELECT n.doc_id,
             CASE WHEN v IS NOT NULL AND c2 > 0 THEN ln(c2 / (c.c - o.c))
                  ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN c1 > 0 THEN ln(c1 / t) ELSE ln(0.4) - ln(greatest(t, 1)) END END AS s,
             CASE WHEN (v IS NOT NULL AND c2 = 0) OR (v IS NULL AND c1 = 0) THEN 1 ELSE 0 END AS b
      FROM n LEFT JOIN c ON c.w = n.v LEFT JOIN o ON o.w = n.v AND o.doc_id = n.doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, round(coalesce(x.s, 0), 3) AS log_score, CAST(coalesce(x.b, 0) AS BIGINT) AS n_backed_off
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS s, sum(b) AS b FROM s GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""

#: The mix with its production parameters: weights 5, 2, 1, share 1.5, cap 2, blocks of 16, shards of 200, seed 7.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][CAST((source_no - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, least(cap, w * max(level) OVER ()) AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER () AS t, count(*) OVER () AS s FROM s4),
s6 AS (SELECT *, CAST(greatest(1, least(16, floor(t / (1000 * s)))) AS BIGINT) AS block FROM s5),
s7 AS (SELECT *, CAST(round(t / block) AS BIGINT) AS house FROM s6),
s8 AS (SELECT *, CASE WHEN t > 0 AND house > s / 2 THEN CAST(floor(target * (house - s / 2) / t + 0.5) AS BIGINT) ELSE 0 END AS base FROM s7),
s9 AS (SELECT *, house - sum(base) OVER () AS rest, unnest(range(CASE WHEN t > 0 THEN CAST(floor(target * s / t) AS BIGINT) + 2 ELSE 1 END)) AS j FROM s8),
s10 AS (SELECT *, target / (2 * (base + j) + 1) AS q FROM s9),
s11 AS (SELECT *, row_number() OVER (ORDER BY q DESC, source_no, j) <= rest AND q > 0 AS won FROM s10),
src AS (SELECT source, source_no, source_size, target, block, max(base) + count(*) FILTER (won) AS house, CAST(greatest(1, least(4096, ceil(source_docs / 200))) AS BIGINT) AS shards
        FROM s11 GROUP BY source, source_no, source_size, source_docs, target, block),
p AS (SELECT d.doc_id, d.size, src.* EXCLUDE (source), CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':7'), 1, 15) AS BIGINT) % shards AS shard,
             CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':8'), 1, 15) AS BIGINT) AS turn_of FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
e AS (SELECT source_no, shard, CAST(sum(size) AS BIGINT) AS line, max(house) AS house, max(block) AS block FROM p GROUP BY source_no, shard),
e1 AS (SELECT *, CAST(sum(line) OVER (PARTITION BY source_no) AS DOUBLE) AS t, count(*) OVER (PARTITION BY source_no) AS s FROM e),
e2 AS (SELECT *, CASE WHEN t > 0 AND house > s / 2 THEN CAST(floor(CAST(line AS DOUBLE) * (house - s / 2) / t + 0.5) AS BIGINT) ELSE 0 END AS base FROM e1),
e3 AS (SELECT *, house - sum(base) OVER (PARTITION BY source_no) AS rest, unnest(range(CASE WHEN t > 0 THEN CAST(floor(CAST(line AS DOUBLE) * s / t) AS BIGINT) + 2 ELSE 1 END)) AS j FROM e2),
e4 AS (SELECT *, CAST(line AS DOUBLE) / (2 * (base + j) + 1) AS q FROM e3),
e5 AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY q DESC, shard, j) <= rest AND q > 0 AS won FROM e4),
e6 AS (SELECT source_no, shard, CAST(ceil(line / block) AS BIGINT) AS n, max(base) + count(*) FILTER (won) AS seats FROM e5 GROUP BY source_no, shard, line, block),
e7 AS (SELECT source_no, shard, n, least(seats, 2 * n) AS quota, CASE WHEN n > 0 THEN CAST('0x' || substr(md5(source_no || ':' || shard || ':7'), 1, 15) AS BIGINT) % n ELSE 0 END AS turn FROM e6),
l AS (SELECT p.*, n, quota, turn, CAST(coalesce(sum(size) OVER (PARTITION BY source_no, shard ORDER BY turn_of, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM p JOIN e7 USING (source_no, shard))
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(quota // n * size + coalesce(list_sum(list_transform(list_filter(range(a // block, (a + size - 1) // block + 1), lambda j: (j * 2147483629 + turn) % n < quota % n),
            lambda j: least(a + size, (j + 1) * block) - greatest(a, j * block))), 0) AS BIGINT) END AS taken
FROM l
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": OP5_SQL, "op7_lm_scoring": OP7_SQL, "op8_mixing": OP8_SQL}
