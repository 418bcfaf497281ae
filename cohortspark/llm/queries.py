"""Registered queries of the text operators: op -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (bpe, decontaminate, exact_dedup, lang_id, license_scan, line_dedup, ngram_join,
                             periodic_runs, pii, prefix_trie, secret_scan, substring_dedup, token_counts)
from cohortspark.llm.common import read_documents
from cohortspark.session import ship_package

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
TOKEN_LIMIT = 1024


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(read_documents(spark, sf_dir)))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read_documents(spark, sf_dir), k=4, num=85, den=100)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_documents(spark, sf_dir))
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(read_documents(spark, sf_dir)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_documents(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(read_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lang_id.identify(read_documents(spark, sf_dir))
    return out.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_documents(spark, sf_dir), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM windows JOIN firsts USING (k), unnest(range(0, 50)) AS r(j) WHERE least < doc_id),
words AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS text
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(read_documents(spark, sf_dir), order=periodic_runs.planted))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    trie = prefix_trie.build_trie(prefix_trie.with_shared_starts(prefix_trie.conversations(turns)))
    return trie.drop("name", "parent")


OP13_SQL = r"""
WITH RECURSIVE byte_steps AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM byte_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM byte_steps WHERE k = 8),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM conversations
  WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, digits, k + 1, xor(t[(xor(v, CAST(ascii(digits[k + 1]) AS BIGINT)) & 255) + 1], v >> 8)
  FROM crc, crc_table WHERE k < length(digits)),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(s.turns[:h], []), o.turns[h + 1:]) AS turns
  FROM own o JOIN (SELECT conv_id, CAST(xor(v, 4294967295) % 6 AS BIGINT) AS h FROM crc WHERE k = length(digits)) USING (conv_id)
  LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 100),
signs AS (
  SELECT conv_id, list_transform(turns, lambda x: md5(length(x.r) || ':' || x.r || x.t)) AS m,
         list_transform(turns, lambda x: length(x.t)) AS points
  FROM rebuilt),
prefixes AS (
  SELECT conv_id, d, array_to_string(m[:d], ' ') AS name, array_to_string(m[:d - 1], ' ') AS parent,
         CASE WHEN d = 0 THEN 0 ELSE points[d] END AS points, d = len(m) AS ends
  FROM signs, unnest(range(0, len(m) + 1)) AS r(d)),
nodes AS (
  SELECT name, d AS depth, min(CASE WHEN d > 0 THEN parent END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         min(points) AS points,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY name, d),
children AS (SELECT parent AS name, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent, depth),
own_values AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * points AS saved
  FROM nodes n LEFT JOIN children c USING (name, depth)),
above AS (
  SELECT DISTINCT p.name AS low, p.d AS low_depth, a.name, a.d AS depth
  FROM prefixes p JOIN nodes n ON n.name = p.name AND n.depth = p.d AND n.conv_id = p.conv_id
  JOIN prefixes a ON a.conv_id = p.conv_id AND a.d <= p.d),
totals AS (
  SELECT above.name, above.depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM above JOIN own_values v ON v.name = above.low AND v.depth = above.low_depth GROUP BY above.name, above.depth)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM own_values v JOIN totals USING (name, depth) LEFT JOIN nodes p ON p.name = v.parent AND p.depth = v.depth - 1
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_license_scan": (op1_license_scan, None),
    "op2_ngram_jaccard": (op2_ngram_jaccard, None),
    "op3_line_dedup": (op3_line_dedup, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_pii": (op6_pii, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_token_counts": (op8_token_counts, None),
    "op9_language_id": (op9_language_id, None),
    "op10_bpe": (op10_bpe, None),
    "op11_substring_dedup": (op11_substring_dedup, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
