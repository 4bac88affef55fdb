"""The opN queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _common as C
from weftgraph.llm import byte_bpe, embedding_join, fingerprints, language_id, ngram_join, packing, pii, quality, token_counts, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(C.documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(C.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(C.documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(C.documents(spark, sf_dir))


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.resolve_revisits(warc.records_of(pages))
    return found.select(
        "record_id", "url_key", "status", "response_id",
        F.col("headers")["etag"].alias("etag"), F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(C.documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade_documents(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(C.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_embedding_join": op6_embedding_join,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
}

#: Canonical URLs as in warc.canonical_url.
_URL_KEY = r"""
    regexp_replace(regexp_replace(lower(regexp_extract(place, '^[^/]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(place, '/.*$'), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""

ORACLE_SQL: dict[str, str] = {
    "op7_warc_revisits": rf"""
WITH plain AS (
    SELECT page_id, md5(html) AS tag, strlen(html) AS size,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM pages
), cut AS (
    SELECT *, regexp_replace(plain, '\?.*$', '') AS place,
           list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM plain
), p AS (
    SELECT page_id, '"' || tag || '"' AS tag, size, {_URL_KEY} AS url_key FROM cut
), found AS (
    SELECT r.page_id, r.url_key, r.tag, max(s.page_id) AS response FROM p r LEFT JOIN p s ON r.url_key = s.url_key AND s.page_id < r.page_id + 1000
    GROUP BY ALL
)
SELECT f.page_id * 2 + 1 AS record_id, f.url_key, CASE WHEN s.page_id IS NULL THEN 'missing' WHEN s.tag = f.tag THEN 'resolved' ELSE 'changed' END AS status,
       s.page_id * 2 AS response_id, CASE WHEN s.tag = f.tag THEN s.tag END AS etag,
       CASE WHEN s.tag = f.tag THEN CAST(f.page_id + 1000 AS VARCHAR) END AS date,
       CASE WHEN s.tag = f.tag THEN CAST(s.size AS VARCHAR) END AS content_length
FROM found f LEFT JOIN p s ON s.page_id = f.response
""",
    "op6_embedding_join": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS MATERIALIZED (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach AS (
    SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT node, min(other) AS other FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce(other, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(other, v.vec_id)) AS kept
FROM v LEFT JOIN least ON node = v.vec_id
""",
    "op8_ngram_join": """
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 75 * (s.n + t.n - k)
), reach AS (
    SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT node, min(other) AS other FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least ON node = w.doc_id
""",
}
