"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import exact_dedup, langid, lm_scoring, metric_tree, mixing, ngram_join, packing, sharding, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), "doc_id")
    return placed.select("doc_id", F.col(placed.columns[-2]).alias("slot"), F.col(placed.columns[-1]).alias("shard"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


# The lookup table is filled anew, turn by turn: a shard's place in its order of preference, and what is taken.
OP2_SQL = """
WITH RECURSIVE
shards AS (SELECT k, ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 4, '0')), 1, 8))::BIGINT % 4099 AS first,
                  ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 4, '0')), 9, 8))::BIGINT % 4098 + 1 AS step FROM range(32) t(k)),
orders AS (SELECT list([(first + j * step) % 4099 FOR j IN range(4099)] ORDER BY k) AS o FROM shards),
fill AS (
  SELECT 0 AS turn, list_resize([]::INT[], 4099, NULL) AS taken FROM orders
  UNION ALL
  SELECT turn + 1, list_transform(taken, lambda x, i: CASE WHEN i = claim + 1 THEN turn % 32 ELSE x END)
  FROM (SELECT turn, taken, list_filter(o[turn % 32 + 1], lambda s: taken[s + 1] IS NULL)[1] AS claim FROM fill, orders WHERE turn < 4099)),
slots AS (SELECT unnest(taken) AS k, unnest(range(4099)) AS slot FROM fill WHERE turn = 4099)
SELECT doc_id, slot::INT AS slot, 'shard-' || lpad(k::VARCHAR, 4, '0') AS shard
FROM documents JOIN slots ON slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4099
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AND row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# A document's own n-grams are taken off; ln(0.4) for each step back.
OP6_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS g1, generate_subscripts(w, 1) AS i, w FROM words),
runs AS (SELECT doc_id, i, g1, CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || g1 END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS p2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || g1 END AS g3 FROM tokens),
own AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, g1 AS g FROM runs UNION ALL SELECT doc_id, g2 FROM runs WHERE g2 IS NOT NULL UNION ALL SELECT doc_id, g3 FROM runs WHERE g3 IS NOT NULL) GROUP BY ALL),
others AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS c FROM own),
total AS (SELECT count(*) AS n FROM tokens),
sizes AS (SELECT doc_id, len(w) AS n FROM words),
scored AS (
  SELECT r.doc_id, CASE
    WHEN c3.c > 0 THEN ln(c3.c / d2.c)
    WHEN c2.c > 0 THEN (CASE WHEN r.g3 IS NOT NULL THEN ln(0.4) ELSE 0 END) + ln(c2.c / d1.c)
    ELSE (CASE WHEN r.g3 IS NOT NULL THEN 2 WHEN r.g2 IS NOT NULL THEN 1 ELSE 0 END) * ln(0.4) + ln(greatest(c1.c, 1) / greatest(total.n - sizes.n, 1)) END AS s
  FROM runs r JOIN sizes USING (doc_id) CROSS JOIN total
  JOIN others c1 ON c1.doc_id = r.doc_id AND c1.g = r.g1
  LEFT JOIN others c2 ON c2.doc_id = r.doc_id AND c2.g = r.g2
  LEFT JOIN others d1 ON d1.doc_id = r.doc_id AND d1.g = r.p1
  LEFT JOIN others c3 ON c3.doc_id = r.doc_id AND c3.g = r.g3
  LEFT JOIN others d2 ON d2.doc_id = r.doc_id AND d2.g = r.p2)
SELECT sizes.doc_id, sizes.n AS n_tokens, round(coalesce(sum(s), 0), 3) AS log_score FROM sizes LEFT JOIN scored USING (doc_id) GROUP BY ALL
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([q.c[i] * v.c[i] FOR i IN range(1, len(q.c) + 1)])::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.c) = len(q.c))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP7_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, range(1, greatest(len(w) - 3, 1)) r(i) WHERE len(w) >= 5
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS src, a AS dst FROM edges UNION SELECT reach.src, edges.b FROM reach JOIN edges ON edges.a = reach.dst)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, coalesce(min(reach.dst), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.src = d.doc_id
GROUP BY d.doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_top_k": op8_top_k,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
}

SQL: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_lm_scoring": OP6_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op8_top_k": OP8_SQL,
}
