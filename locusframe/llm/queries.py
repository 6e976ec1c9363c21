"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import ann, decontaminate, html_extract, langid, lm_score, mixing, pii, secrets, token_orc
from locusframe.llm.minhash import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), name="op2")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), name="op3")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenized(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), name="op4")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), vocab=public_tokenizers.path("piece_bpe_32k.model"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(85, 100), name="op6")
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"), name="op9")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_multiprobe_lsh": op1_multiprobe_lsh,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_secrets": op3_secrets,
    "op4_token_orc": op4_token_orc,
    "op5_langid": op5_langid,
    "op6_minhash": op6_minhash,
    "op7_lm_score": op7_lm_score,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT x FROM items GROUP BY x HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE a.x IN (SELECT x FROM common) GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN (SELECT doc_id AS a, len(s) AS na FROM sets) USING (a) JOIN (SELECT doc_id AS b, len(s) AS nb FROM sets) USING (b)
  WHERE 100 * n >= 85 * (na + nb - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS root, doc_id AS node FROM sets
  UNION SELECT r.root, l.b FROM reach r JOIN both_ways l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
"""

OP8_SQL = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (
  SELECT item_id, least(len(w), 8) AS k, unnest(list_transform(range(1, greatest(len(w) - 6, 2)), lambda i: array_to_string(w[i:least(i + 7, len(w))], ' '))) AS x
  FROM bw WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM bwin),
dwin AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, lens WHERE len(w) >= k),
hits AS (SELECT DISTINCT d.doc_id, d.i, d.k, b.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM dwin) d JOIN bwin b ON b.x = d.x AND b.k = d.k),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN own USING (doc_id)
"""

ORACLE = {"op6_minhash": OP6_SQL, "op8_decontaminate": OP8_SQL}
