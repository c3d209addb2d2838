"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import decontaminate, fingerprint, html, jaccard, mixing, paragraphs, pii, quality, toxicity, urls
from quotelens.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.find_leaks(docs, items, keep=["doc_id"]))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, ["doc_id"]).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.AT).cast("int").alias("predicted"),
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op7_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs), ["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, ["doc_id"]).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.AT).cast("int").alias("predicted"),
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_main_text": op5_main_text,
    "op6_fingerprints": op6_fingerprints,
    "op7_near_documents": op7_near_documents,
    "op8_personal_data": op8_personal_data,
    "op9_quality": op9_quality,
    "op10_repeated_passages": op10_repeated_passages,
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_WORDS}'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)
), g AS (
  SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS gram
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), h AS (
  SELECT g.doc_id, g.k, g.m, p.item_id FROM g JOIN p ON g.gram = p.gram AND g.m = p.m
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS sha
  FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, coalesce(items.sha, sha256('')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL}
