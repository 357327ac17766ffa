"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import additive_quantizer, bpe, exact_dedup, mixing, prefix_trie, quality, simhash, token_counts, token_files, toxicity, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_additive_quantizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantizer.search(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("epochs")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_additive_quantizer, op2_toxicity, op3_simhash, op4_exact_dedup, op5_mixing, op6_quality, op7_token_counts, op8_bpe, op9_token_files, op10_warc, op11_url_filter, op12_whitening, op13_prefix_trie)}


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars, (CAST('0x' || substr(md5(doc_id || ':7'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (CASE WHEN size >= 20 AND chars >= 3 * size AND chars <= 13 * size THEN 1.0 ELSE 0.25 END)::DOUBLE AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2 * s AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, max(CASE WHEN cap >= level * w THEN level END) OVER () AS waterline FROM l),
t AS (SELECT source, s, coalesce(least(cap, waterline * w), cap) AS target FROM m),
e AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM t),
p AS (SELECT k.*, e.s, e.target, e.whole, e.target - e.whole * e.s AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN upto - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM p
"""

OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

# crc32 by its polynomial, bit by bit over the decimal digits
OP13_SQL = """
WITH p AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT c, max(pos) AS n, c - c % 5 AS base,
         xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ord(s)::BIGINT), lambda a, x:
           list_reduce([xor(a, x)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))) % 9 AS h
  FROM p GROUP BY c),
b AS (SELECT n.*, least(n.h, coalesce(m.n, 0)) AS taken FROM n LEFT JOIN n m ON m.c = n.base),
t AS (
  SELECT b.c, p.pos AS d, role, text FROM b JOIN p ON p.c = b.base AND p.pos <= b.h
  UNION ALL SELECT b.c, taken + pos - h, role, text FROM p JOIN b USING (c) WHERE pos > h),
k AS (
  SELECT c, d, text, list(struct_pack(r := role, x := text)) OVER (PARTITION BY c ORDER BY d) AS seq, d = max(d) OVER (PARTITION BY c) AS ends FROM t
  UNION ALL SELECT c, 0, '', CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]), NOT EXISTS (SELECT 1 FROM t WHERE t.c = b.c) FROM b),
m AS (SELECT seq, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY seq),
f AS (SELECT u.seq AS up, count(*) AS n_children FROM m JOIN m u ON m.depth > 0 AND u.seq = m.seq[1:m.depth - 1] GROUP BY u.seq),
g AS (SELECT k.seq, sum(CASE WHEN f.up IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved_tokens FROM m LEFT JOIN f ON f.up = m.seq JOIN k ON k.c = m.conv_id AND k.d <= m.depth GROUP BY k.seq)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(coalesce(f.n_children, 0) AS BIGINT) AS n_children,
       CAST(g.n_leaves AS BIGINT) AS n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m LEFT JOIN m u ON m.depth > 0 AND u.seq = m.seq[1:m.depth - 1] LEFT JOIN f ON f.up = m.seq JOIN g ON g.seq = m.seq
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: XXH64, trained models and tokenizers are beyond it. tests/llm holds them against brute force."""
    return {"op4_exact_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op10_warc": OP10_SQL, "op13_prefix_trie": OP13_SQL}
