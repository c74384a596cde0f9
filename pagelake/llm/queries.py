"""Queries of the text operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boilerplate import boilerplate_lines, main_text
from .engine import table
from .language import detect_languages, fit_languages, language_found
from .leakage import leaked_items
from .markup import clean_documents
from .quality import quality_found, quality_statistics
from .repeated import repeated_lines, without_repeated_lines
from .residue import residue_records
from .spam import spam_records
from .tokenizer import encode_texts
from .truncation import truncated, truncation_rates


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = boilerplate_lines(
        table(spark, sf_dir, "crawl_docs"), "page_id", {"crawl_docs.markdown": ("markdown", False), "crawl_docs.html": ("html", True)}
    )
    cache = boilerplate_lines(table(spark, sf_dir, "page_cache"), "cache_id", {"page_cache.html": ("html", True)})
    return docs.unionAll(cache)


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown").withColumnRenamed("row_id", "page_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_documents(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "html", "metadata.status_code", with_text=False)
    return docs.select("page_id", "field", F.explode("markup").alias("markup"))


def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "html", "metadata.status_code")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_found(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "metadata.language", "metadata.status_code", "links")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs")
    crf = fit_languages(docs, "page_id", "markdown", "metadata.language")
    return detect_languages(docs, "page_id", "markdown", crf).withColumn("confidence", F.round("confidence", 4))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_records(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "metadata.status_code")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_records(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "metadata.status_code", "links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "url")


def p6_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "url")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_found(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown", "metadata.word_count", "metadata.status_code", "links").select("page_id", "kind")


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_statistics(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown").withColumnRenamed("row_id", "page_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "content_length").where("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "content_length"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_HOST = r"regexp_replace(nullif(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1), ''), '^www\.', '')"
_EDGES = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"

P6_FOUND = rf"""
WITH d AS (SELECT page_id, {_HOST} AS host, string_split(markdown, chr(10)) AS ls FROM crawl_docs),
n AS (SELECT host, count(*) AS docs FROM d WHERE host IS NOT NULL GROUP BY host),
l AS (SELECT page_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM d WHERE host IS NOT NULL),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS mark, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) AS marks FROM l),
k AS (SELECT page_id, host, line_no, regexp_replace(regexp_replace(lower(regexp_replace(trim(line), '\s+', ' ', 'g')), {_EDGES}, '', 'g'), '\p{{Nd}}+', '0', 'g') AS key
      FROM f WHERE NOT mark AND marks % 2 = 0 AND regexp_matches(line, '\p{{L}}')),
c AS (SELECT k.host, key FROM k JOIN n ON k.host = n.host GROUP BY k.host, key, n.docs HAVING count(DISTINCT page_id) >= 4 AND count(DISTINCT page_id) >= 0.1 * n.docs)
SELECT k.page_id, CAST(k.line_no AS INTEGER) AS line_no FROM k JOIN c ON k.host = c.host AND k.key = c.key
"""

P9_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.x = iw.x
"""

P7_WORDS = r"""
SELECT page_id, CAST(len(list_filter(regexp_split_to_array(markdown, '[\s\p{Z}]+'), lambda w: w <> '')) AS BIGINT) AS words FROM crawl_docs WHERE markdown IS NOT NULL
"""


def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_statistics(table(spark, sf_dir, "crawl_docs"), "page_id", "markdown")
    return stats.where("words IS NOT NULL").select(F.col("row_id").alias("page_id"), "words")


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express over whole tables; the others
    are tested against brute force, round trips or held-out rows."""
    return {"p6_found": P6_FOUND, "p7_words": P7_WORDS, "p9_found": P9_FOUND}
