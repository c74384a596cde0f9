"""Schemas of the tables that pipelines read and write, as DDL."""

METADATA = (
    "STRUCT<title: STRING, description: STRING, language: STRING, keywords: STRING, robots: STRING, og_title: STRING, og_description: STRING, og_url: STRING,"
    " og_image: STRING, url: STRING, source_url: STRING, status_code: INT, content_type: STRING, canonical_url: STRING, word_count: BIGINT, reading_time: BIGINT,"
    " excerpt: STRING, detected_frameworks: ARRAY<STRING>, detection_reason: STRING, content_script_ratio: DOUBLE>"
)
RAW_PAGE = "page_id BIGINT, url STRING, status_code INT, content_type STRING, html STRING, headers ARRAY<STRUCT<k: STRING, v: STRING>>, fetched_at TIMESTAMP"
DOCUMENT = f"title STRING, description STRING, url STRING, markdown STRING, html STRING, raw_html STRING, links ARRAY<STRING>, images ARRAY<STRING>, screenshot STRING, metadata {METADATA}"
EDGE = "src STRING, dst STRING, kind STRING, pos INT"
FRONTIER = "url STRING, depth INT, priority INT, host STRING, discovered_from STRING"
EVENT = (
    "type STRING, url STRING, title STRING, markdown STRING, metadata STRING, pages_crawled BIGINT, queue_size BIGINT, current_url STRING, error STRING,"
    " total_pages BIGINT, success BIGINT, errors BIGINT"
)
HTML_TABLE = "headers ARRAY<STRING>, rows ARRAY<MAP<STRING, STRING>>"
