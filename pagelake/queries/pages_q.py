"""Queries over HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html_text as H
from ..functions import markdown_clean as M
from ..functions import scalars as S
from ..functions import text as T
from ..functions import urls as U
from .registry import query, sql_any, sql_count, sql_trim, sql_words
from .registry import wide_table as table


def _entities_sql(x: str) -> str:
    for a, b in S.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _filled(x: str) -> str:
    return f"nullif({sql_trim(x)}, '')"


_TITLE = _filled(_entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def _meta_sql(name: str, attribute: str = "name") -> str:
    a = f"""regexp_extract(html, '(?is)<meta[^>]*\\s{attribute}=["'']{name}["''][^>]*\\scontent="([^"]*)"', 1)"""
    b = f"""regexp_extract(html, '(?is)<meta[^>]*\\scontent="([^"]*)"[^>]*\\s{attribute}=["'']{name}["'']', 1)"""
    return f"coalesce({_filled(_entities_sql(a))}, {_filled(_entities_sql(b))})"


@query(
    f"""SELECT cache_id, {_TITLE} AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=["'']?([^"''>\\s]*)', 1), '') AS lang, {_meta_sql('description')} AS description,
    {_meta_sql('og:title', 'property')} AS og_title, {_filled(_entities_sql("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS heading FROM page_cache"""
)
def page_metadata(s, d):
    h = F.col("html")
    return table(s, d, "page_cache").select(
        "cache_id", H.title(h).alias("title"), H.language(h).alias("lang"), H.meta(h, "description").alias("description"), H.meta(h, "og:title", "property").alias("og_title"),
        H.first_heading(h).alias("heading"),
    )


_HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)"


@query(f"SELECT cache_id, CAST(pos AS BIGINT) AS pos, {_entities_sql('link')} AS link FROM (SELECT cache_id, unnest({_HREFS}) AS link, generate_subscripts({_HREFS}, 1) - 1 AS pos FROM page_cache)")
def link_extract(s, d):
    x = table(s, d, "page_cache").select("cache_id", F.posexplode(H.hrefs(F.col("html"))).alias("pos", "link"))
    return x.select("cache_id", F.col("pos").cast("long").alias("pos"), "link")


@query(
    f"""SELECT cache_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({_HREFS}, lambda u: NOT regexp_matches(lower(u), '^(javascript:|mailto:|tel:|#)') AND u <> ''),
    lambda u: regexp_replace(u, '#.*$', '')))), ' ') AS links FROM page_cache WHERE html IS NOT NULL"""
)
def link_distinct_sorted(s, d):
    return table(s, d, "page_cache").where("html IS NOT NULL").select("cache_id", F.array_join(H.crawl_links(F.col("html")), " ").alias("links"))


@query(
    """SELECT cache_id, src FROM (SELECT cache_id, unnest(regexp_extract_all(html, '(?i)<img\\s[^>]*?src="([^"]*)"', 1)) AS src FROM page_cache) WHERE src <> '' AND NOT starts_with(src, 'data:')"""
)
def image_extract(s, d):
    return table(s, d, "page_cache").select("cache_id", F.explode(H.image_sources(F.col("html"))).alias("src"))


_STRIP = "html"
for _p in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?is)<noscript\\b.*?</noscript>", "(?is)<svg\\b.*?</svg>", "(?is)<head\\b.*?</head>", "(?s)<!--.*?-->"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '', 'g')"
_PLAIN = "trim(regexp_replace(" + _entities_sql(f"regexp_replace({_STRIP}, '<[^>]*>', ' ', 'g')") + ", '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"SELECT cache_id, {_PLAIN} AS text, {sql_words(_PLAIN)} AS words, round(coalesce(octet_length(encode({_PLAIN})) / octet_length(encode(html)), 0), 6) AS density FROM page_cache")
def page_text(s, d):
    t = H.plain_text(F.col("html"))
    return table(s, d, "page_cache").select("cache_id", t.alias("text"), T.word_count(t).alias("words"), F.round(H.text_density(F.col("html")), 6).alias("density"))


@query(
    f"""SELECT cache_id, coalesce(status_code IN (401, 403, 429, 503) OR (status_code >= 400 AND {sql_any('lower(html)', H.BLOCK_PHRASES)}), false) AS wants_browser,
    coalesce({' + '.join(f"CAST(contains(html, '{m}') AS INTEGER)" for m in H.PAGE_MARKS)} >= 2, false) AS has_marks,
    coalesce(status_code >= 400 OR (status_code >= 200 AND status_code < 300 AND NOT coalesce({' + '.join(f"CAST(contains(html, '{m}') AS INTEGER)" for m in H.PAGE_MARKS)} >= 2, false)
    AND CAST({sql_any('lower(html)', H.ERROR_TITLES)} AS INTEGER) + CAST({sql_any('lower(html)', H.ERROR_HEADINGS)} AS INTEGER) + CAST({sql_any('lower(html)', H.ERROR_PHRASES)} AS INTEGER) >= 2), false) AS error_page
    FROM page_cache"""
)
def page_gates(s, d):
    h, c = F.col("html"), F.col("status_code")
    return table(s, d, "page_cache").select("cache_id", H.wants_browser(h, c).alias("wants_browser"), H.has_page_marks(h).alias("has_marks"), H.is_error_page(h, c).alias("error_page"))


_SRC = "lower(array_to_string(regexp_extract_all(html, '(?is)<script[^>]*\\ssrc=\"([^\"]*)\"', 1), chr(10)))"


@query(
    "SELECT cache_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any('html', m)} OR {sql_any(_SRC, p)} THEN '{n}' END" for n, (m, p) in H.FRAMEWORKS.items()) + "], lambda x: x IS NOT NULL), ',') AS frameworks,"
    f" {sql_any('html', H.HYDRATION_MARKS)} AS hydration FROM page_cache WHERE html IS NOT NULL"
)
def page_frameworks(s, d):
    h = F.col("html")
    return table(s, d, "page_cache").where("html IS NOT NULL").select("cache_id", F.array_join(H.frameworks(h), ",").alias("frameworks"), H.hydration(h).alias("hydration"))


@query(
    f"""WITH m AS (SELECT page_id, markdown, list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*#{{1,6}} ')) AS h, list_filter(string_split(markdown, chr(10)),
    lambda x: regexp_matches(x, '^[ \\t]*(?:[-*+] |[0-9].*[.)] )')) AS l FROM crawl_docs)
    SELECT page_id, {sql_words('markdown')} AS word_count, CAST(coalesce(octet_length(encode(markdown)), 0) AS BIGINT) AS markdown_length, CAST(coalesce(len(h), 0) AS BIGINT) AS heading_count,
    CAST({sql_count('markdown', '```')} // 2 AS BIGINT) AS code_block_count, {sql_count('markdown', '</')} AS html_artifact_count, {sql_count("replace(markdown, '![](', '')", '[](')} AS empty_link_count,
    {sql_count('markdown', 'data:image/')} + {sql_count('markdown', 'data:application/')} AS base64_count, CAST(coalesce(len(l), 0) AS BIGINT) AS list_count,
    round(coalesce({sql_words('markdown')} / nullif(octet_length(encode(markdown)) / 1024.0, 0), 0), 6) AS content_density, sha256(markdown) AS content_hash FROM m"""
)
def md_objective_metrics(s, d):
    m = T.objective_metrics(F.col("markdown"))
    m["content_density"] = F.round(m["content_density"], 6)
    return table(s, d, "crawl_docs").select("page_id", *[c.alias(n) for n, c in m.items()])


@query(
    """WITH l AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM crawl_docs WHERE markdown IS NOT NULL),
    f AS (SELECT *, starts_with(ltrim(line, ' '), '```') AS mark FROM l), g AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos) % 2 = 1 AS fence FROM f),
    r AS (SELECT *, (NOT mark AND NOT fence AND starts_with(ltrim(line, ' '), '|')) AS is_row FROM g), t AS (SELECT *, lag(is_row, 1, false) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM r)
    SELECT page_id, CAST(sum(CASE WHEN is_row AND NOT before THEN 1 ELSE 0 END) AS BIGINT) AS tables FROM t GROUP BY page_id"""
)
def md_table_count(s, d):
    return table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", T.table_count(F.col("markdown")).alias("tables"))


def _md_steps_sql() -> str:
    x = "markdown"
    x = f"translate({x}, '{S.INVISIBLE}', '')"
    x = f"regexp_replace({x}, '(?m)[ \\t\\r\\f]+$', '', 'g')"
    x = f"regexp_replace({x}, '(!\\[[^\\]]*\\])\\(data:[^)]*\\)', '\\1(data:image-removed)', 'g')"
    x = f"regexp_replace({x}, '(^|[^!])\\[[ \\t]*\\]\\([^)]*\\)', '\\1', 'g')"
    x = f"regexp_replace({x}, '(?m)^[ \\t]*(?:{'|'.join(M.UI_NOISE)})[ \\t]*$', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^[ \\t]*Copyright[ \\t]+©[^\\n]*$', '', 'g')"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, {_md_steps_sql()} AS markdown FROM crawl_docs")
def md_cleanup_regex(s, d):
    m = S.strip_invisible(F.col("markdown"))
    m = F.regexp_replace(m, "(?m)(?d)[ \\t\\r\\f]+$", "")
    for step in (M.drop_base64_images, M.drop_empty_links, M.drop_ui_noise, M.drop_copyright):
        m = step(m)
    return table(s, d, "crawl_docs").select("page_id", T.squeeze_blank_lines(m).alias("markdown"))


@query()
def md_clean_full(s, d):
    return table(s, d, "crawl_docs").select("page_id", M.clean(M.compress_tables(F.col("markdown"))).alias("markdown"))


_CELL = "trim(translate(c, chr(9), ' '))"


@query(
    """WITH l AS (SELECT page_id, string_split(markdown, chr(10)) AS ls FROM crawl_docs WHERE markdown IS NOT NULL)
    SELECT page_id, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), '^\\|.*\\|$') THEN
    array_to_string(list_transform(string_split(regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), '|'), lambda c: CASE WHEN """ + _CELL + """ = '' THEN '' WHEN regexp_matches(""" + _CELL + """, '^[-: ]+$') THEN
    CASE WHEN starts_with(""" + _CELL + """, ':') AND """ + _CELL + """ LIKE '%_:' THEN ' :---: ' WHEN """ + _CELL + """ LIKE '%:' THEN ' ---: ' WHEN starts_with(""" + _CELL + """, ':') THEN ' :--- ' ELSE ' --- ' END
    ELSE ' ' || """ + _CELL + """ || ' ' END), '|') ELSE x END), chr(10)) AS markdown FROM l"""
)
def md_compress_tables(s, d):
    return table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", M.compress_tables(F.col("markdown")).alias("markdown"))


def _excerpt_sql(x: str) -> str:
    t = sql_trim(x)
    head = f"substring({t}, 1, 200)"
    sentence, word = f"regexp_extract({head}, '(?s)^(.*[.!?]) ', 1)", f"regexp_extract({head}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({t}) > 0 THEN CASE WHEN length({t}) <= 200 THEN {t} WHEN {sentence} <> '' THEN {sentence} WHEN {word} <> '' THEN {word} || '...' ELSE {head} || '...' END END"


@query(f"SELECT doc_id, {sql_words('text')} AS words, CAST(ceil({sql_words('text')} / 200.0) AS BIGINT) AS minutes, {_excerpt_sql('text')} AS excerpt FROM documents")
def doc_reading_time(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.word_count(t).alias("words"), T.reading_time(t).alias("minutes"), T.excerpt(t).alias("excerpt"))


_NORM = sql_trim("regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(
    f"WITH h AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM h WHERE h IS NOT NULL GROUP BY h) SELECT h.doc_id AS id, coalesce(f.first_id, h.doc_id) AS first_id, coalesce(f.first_id, h.doc_id) <> h.doc_id AS is_duplicate FROM h LEFT JOIN f ON h.h = f.h"
)
def doc_dedup_exact(s, d):
    from ..operators.dedup import content_duplicates

    return content_duplicates(table(s, d, "documents"), "doc_id", "text")


@query(f"SELECT count(DISTINCT sha256({_NORM})) AS n FROM documents")
def doc_distinct_count(s, d):
    from ..operators.dedup import distinct_contents

    return distinct_contents(table(s, d, "documents"), "text")


@query(f"SELECT sha256({_NORM}) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def doc_dup_groups(s, d):
    from ..operators.dedup import duplicate_groups

    return duplicate_groups(table(s, d, "documents"), "doc_id", "text")


@query("SELECT cache_id, coalesce(nullif(regexp_extract(lower(content_type), 'charset=[\"'']?([a-z0-9_-]+)', 1), ''), nullif(regexp_extract(lower(substring(html, 1, 2048)), '<meta[^>]*charset=[\"'']?([a-z0-9_-]+)', 1), ''), 'utf-8') AS charset FROM page_cache")
def page_charset(s, d):
    return table(s, d, "page_cache").select("cache_id", H.charset(F.col("content_type"), F.col("html")).alias("charset"))


@query("SELECT cache_id, CAST(list_sum(list_transform(regexp_extract_all(html, '(?is)(<table[^>]*>.*?</table>)', 1), lambda t: octet_length(encode(t)))) AS BIGINT) AS bytes FROM page_cache WHERE html ILIKE '%<table%</table>%'")
def table_bytes(s, d):
    return table(s, d, "page_cache").where("html ILIKE '%<table%</table>%'").select("cache_id", H.table_bytes(F.col("html")).alias("bytes"))


# ---- Python operators: no SQL twin -----------------------------------------------------


@query()
def html_markdown(s, d):
    from ..operators.pages import to_markdown

    return to_markdown(table(s, d, "page_cache"), "cache_id", "html", "url").withColumnRenamed("row_id", "cache_id")


@query()
def html_metadata(s, d):
    from ..operators.pages import metadata

    return metadata(table(s, d, "page_cache"), "cache_id", "html", "url").withColumnRenamed("row_id", "cache_id")


@query()
def html_tables(s, d):
    from ..operators.pages import html_tables as op

    x = op(table(s, d, "page_cache"), "cache_id", "html")
    return x.select(F.col("row_id").alias("cache_id"), "table_no", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"))


@query()
def scrape_documents(s, d):
    from ..operators.pages import scrape
    from ..options import ScrapeOptions

    return scrape(table(s, d, "page_cache"), ScrapeOptions(formats=("markdown", "links", "images")), "cache_id").drop("screenshot")


@query()
def css_extract(s, d):
    from ..operators.pages import extract
    from ..options import ExtractOptions

    o = ExtractOptions(
        selectors={"heading": "h1", "items": "li", "rows": "table tr", "first_link": "a[href^='http']"},
        schema={"properties": {"items": {"type": "array"}, "rows": {"type": "array"}}},
        mode="css",
    )
    return extract(table(s, d, "page_cache"), "cache_id", "html", o)


@query()
def engine_choice(s, d):
    from ..operators.pages import engine_choice as op

    return op(table(s, d, "page_cache"), "cache_id")


@query()
def detect_scripts(s, d):
    need = H.needs_scripts(F.col("html"))
    return table(s, d, "page_cache").where("html IS NOT NULL").select("cache_id", *[c.alias(n) for n, c in need.items()])


# ---- small fixtures as values ---------------------------------------------------------

_NUMBERS = ["$999.99", "1,234.5", "-7", "no number", "", "4.5.6", "12-3", "42 items"]


@query("SELECT v AS text, try_cast(nullif(regexp_replace(v, '[^0-9.-]', '', 'g'), '') AS DOUBLE) AS number, lower(trim(v)) IN ('true', 'yes', '1') AS truth FROM (VALUES " + ", ".join(f"('{x}')" for x in [*_NUMBERS, "Yes", " TRUE ", "1", "no"]) + ") t(v)")
def parse_values(s, d):
    x = s.createDataFrame([(v,) for v in [*_NUMBERS, "Yes", " TRUE ", "1", "no"]], "text STRING")
    return x.select("text", S.parse_number(F.col("text")).alias("number"), S.parse_boolean(F.col("text")).alias("truth"))


_SRCSETS = {"a.jpg 300w, b.jpg 900w, c.jpg 600w": "b.jpg", "a.jpg 1x, b.jpg 2x": "b.jpg", "only.png": "only.png", "x.png 2x, y.png 1200w": "x.png", "p.png 10w,q.png 10w": "p.png"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SRCSETS.items()) + ") t(srcset, largest)")
def srcset_largest(s, d):
    x = s.createDataFrame([(k,) for k in _SRCSETS], "srcset STRING")
    return x.select("srcset", S.largest_of_srcset(F.col("srcset")).alias("largest"))


@query("SELECT i AS step, CAST(v AS BIGINT) AS delay_ms FROM (VALUES (1, 200), (2, 300), (3, 450), (4, 675)) t(i, v)")
def retry_schedule(s, d):
    return s.range(1).select(F.posexplode(S.backoff_schedule(5, 200, 1.5, 10_000)).alias("i", "delay_ms")).select((F.col("i") + 1).alias("step"), "delay_ms")


@query(
    """SELECT * FROM (VALUES ('invalid_url', 400), ('invalid_request', 400), ('invalid_selector', 400), ('robots_disallowed', 403), ('ssrf', 403), ('not_found', 404), ('timeout', 408), ('empty_content', 422),
    ('low_quality', 422), ('error_page', 422), ('rate_limit', 429), ('internal', 500), ('browser', 500), ('request_failed', 502), ('resource_limit', 503), ('something_else', 500)) t(kind, status)"""
)
def http_status_map(s, d):
    x = s.createDataFrame([(k,) for k in [*S.STATUS_OF, "something_else"]], "kind STRING")
    return x.select("kind", S.status_of(F.col("kind")).alias("status"))


@query("SELECT url, CASE WHEN length(url) > 8 THEN substring(url, 1, 8) || '...' ELSE url END AS redacted FROM (SELECT DISTINCT url FROM page_cache WHERE url IS NOT NULL)")
def key_redact(s, d):
    return table(s, d, "page_cache").select("url").where("url IS NOT NULL").distinct().select("url", S.redact(F.col("url")).alias("redacted"))


@query("SELECT page_id, " + _entities_sql("markdown") + " AS decoded FROM crawl_docs WHERE contains(markdown, '&')")
def entity_decode(s, d):
    return table(s, d, "crawl_docs").where(F.col("markdown").contains("&")).select("page_id", S.decode_entities(F.col("markdown")).alias("decoded"))


_REPLIES = {
    '{"description": "A page about kilns"}': "A page about kilns",
    '```json\n{"description": "Fenced"}\n```': "Fenced",
    "A plain line\nand more": "A plain line",
    "x" * 130: "x" * 100,
}


@query("SELECT * FROM (VALUES " + ", ".join("('" + k.replace("\n", "' || chr(10) || '") + f"', '{v}')" for k, v in _REPLIES.items()) + ") t(reply, description)")
def reply_description(s, d):
    x = s.createDataFrame([(k,) for k in _REPLIES], "reply STRING")
    return x.select("reply", S.description_of_reply(F.col("reply")).alias("description"))


@query()
def llm_stub_extract(s, d):
    from ..operators.pages import extract
    from ..options import ExtractOptions

    def model(text: str, schema: dict) -> dict:
        return {"first_line": text.split("\n", 1)[0], "length": len(text)}

    return extract(table(s, d, "page_cache"), "cache_id", "html", ExtractOptions(selectors={"price": ".price"}, mode="auto"), model)


@query(
    r"""SELECT page_id, coalesce(nullif({TT}, ''), nullif(split_part(regexp_replace(url, '/+$', ''), '/', -1), ''), 'Untitled') AS title,
    substring(coalesce(nullif({DD}, ''), nullif({OO}, ''), 'No description available'), 1, 150) AS text FROM crawl_docs WHERE url IS NOT NULL""".replace("{TT}", sql_trim("title")).replace("{DD}", sql_trim("description")).replace("{OO}", sql_trim("metadata.og_description"))
)
def digest_fields(s, d):
    from ..plans.digest import digest_description, digest_title

    x = table(s, d, "crawl_docs").where("url IS NOT NULL")
    return x.select("page_id", digest_title(F.col("title"), F.lit(None).cast("string"), F.col("url")).alias("title"), digest_description(F.col("description"), F.col("metadata.og_description")).alias("text"))


@query()
def link_resolve(s, d):
    x = table(s, d, "crawl_docs").where("url IS NOT NULL").select("page_id", "url", F.explode(F.array(*[F.lit(v) for v in ("/a/b", "//cdn.example/x", "?q=1", "#top", "c.html", "https://z.example/")])).alias("link"))
    return x.select("page_id", "link", U.resolve(F.col("url"), F.col("link")).alias("resolved"))
