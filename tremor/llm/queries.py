"""The thin queries of the corpus operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import ann, centroids, extraction, fim, jaccard, langid, licenses, linededup, media, mixing, pieces, secrets, toxicity
from tremor.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbour_report(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extraction_report(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_sentencepiece, op3_ngram_jaccard, op4_language_id, op5_nearest_neighbours, op6_license_scan, op7_source_mix, op8_media_columns, op9_line_dedup, op10_toxicity, op11_fill_in_middle, op12_html_extraction, op13_centroid_clustering)}

#: All pairs of documents that share a shingle, and all documents reachable by links: for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
link AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM u p JOIN u q ON p.t = q.t AND p.doc_id <> q.doc_id GROUP BY 1, 2) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE 100 * k >= 85 * (na.n + nb.n - k)
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
SELECT n.doc_id, n.n AS n_shingles, c.m AS component_id FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = n.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard": JACCARD_SQL, "op11_fill_in_middle": fim.SQL, "op12_html_extraction": extraction.SQL, "op13_centroid_clustering": centroids.SQL}
