"""URL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from .registry import query, sql_canonical, sql_host, sql_path, sql_query, sql_site
from .registry import wide_table as table

URLS = "crawl_docs"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crawl_docs").select("page_id", "url")


@query(f"SELECT page_id, {sql_host('url')} AS host, {sql_site('url')} AS site, {sql_path('url')} AS path, {sql_query('url')} AS query FROM crawl_docs")
def url_parts(s, d):
    u = F.col("url")
    return _docs(s, d).select("page_id", U.host(u).alias("host"), U.site(u).alias("site"), U.path(u).alias("path"), U.query(u).alias("query"))


@query("SELECT page_id, coalesce(regexp_matches(lower(url), '^https?://'), false) AS is_http, coalesce(octet_length(encode(url)) <= 2048 AND " + sql_host("url") + " IS NOT NULL, false) AS is_valid FROM crawl_docs")
def url_validity(s, d):
    u = F.col("url")
    return _docs(s, d).select("page_id", U.is_http(u).alias("is_http"), U.is_valid(u).alias("is_valid"))


@query(f"SELECT page_id, {sql_canonical('url')} AS canonical FROM crawl_docs")
def url_canonical(s, d):
    return _docs(s, d).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(
    r"""WITH b AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM crawl_docs),
    h AS (SELECT *, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) AS head FROM b)
    SELECT page_id, CASE WHEN """ + sql_host("url") + r""" IS NULL THEN url ELSE regexp_replace(lower(head) || substring(bare, length(head) + 1), '/$', '') END AS canonical FROM h"""
)
def url_canonical_light(s, d):
    return _docs(s, d).select("page_id", U.canonical_light(F.col("url")).alias("canonical"))


@query(
    "WITH u AS (SELECT DISTINCT " + sql_site("url") + " AS site, regexp_replace(regexp_replace(" + sql_path("url") + r", '/+$', ''), '/index\.(html|php)$', '') AS base FROM crawl_docs WHERE " + sql_host("url") + """ IS NOT NULL)
    SELECT DISTINCT site || base AS page, h.v || site || base || e.v AS spelling FROM u, (VALUES ('http://'), ('http://www.'), ('https://'), ('https://www.')) h(v),
    (VALUES (''), ('/'), ('/index.html'), ('/index.html/'), ('/index.php'), ('/index.php/')) e(v)"""
)
def url_permutations(s, d):
    docs = _docs(s, d).where(U.host(F.col("url")).isNotNull())
    base = F.regexp_replace(F.regexp_replace(U.path(F.col("url")), "/+$", ""), r"/index\.(html|php)$", "")
    return docs.select(F.concat(U.site(F.col("url")), base).alias("page"), F.explode(U.permutations(F.col("url"))).alias("spelling")).distinct()


def _priority_sql(u: str, depth: str) -> str:
    high = "|".join(f"(?:{p})" for p in U.HIGH_PRIORITY)
    low = "|".join(f"(?:{p})" for p in U.LOW_PRIORITY)
    p = sql_path(u)
    slashes = f"(length({p}) - length(replace({p}, '/', '')))"
    size = f"(octet_length(encode({u})) + CASE WHEN {p} = '' THEN 1 ELSE 0 END)"
    return (
        f"CASE WHEN {u} IS NOT NULL THEN CAST(100 + coalesce(CASE WHEN {p} IN ('', '/') THEN 100 WHEN {slashes} = 1 OR ({slashes} = 2 AND {p} LIKE '%/') THEN 40 ELSE 0 END, 0) - ({depth}) * 10"
        f" + CASE WHEN regexp_matches({u}, '{high}') THEN 50 ELSE 0 END - CASE WHEN regexp_matches({u}, '{low}') THEN 50 ELSE 0 END"
        f" - coalesce(CASE WHEN {p} IS NOT NULL AND {size} > 100 THEN ({size} - 100) // 10 ELSE 0 END, 0) AS INTEGER) END"
    )


@query(f"SELECT page_id, {_priority_sql('url', 'page_id % 5')} AS priority FROM crawl_docs")
def url_priority(s, d):
    return _docs(s, d).select("page_id", U.priority(F.col("url"), F.col("page_id") % 5).alias("priority"))


@query(
    """SELECT page_id, CAST(1000 - (page_id % 5) * 100 + CASE WHEN page_id % 3 = 0 THEN 500 ELSE 0 END + CASE WHEN contains(url, '/docs/') THEN 200 ELSE 0 END
    + CASE WHEN contains(url, '/api/') THEN 150 ELSE 0 END + CASE WHEN contains(url, '/blog/') THEN 100 ELSE 0 END - CASE WHEN contains(url, '?') THEN 50 ELSE 0 END
    - CASE WHEN contains(url, '#') THEN 25 ELSE 0 END AS BIGINT) AS score FROM crawl_docs"""
)
def url_priority_bench(s, d):
    return _docs(s, d).select("page_id", U.priority_bench(F.col("url"), F.col("page_id") % 5, F.col("page_id") % 3 == 0).alias("score"))


@query(
    r"""WITH e AS (SELECT DISTINCT dst FROM crawl_edges WHERE dst IS NOT NULL), n AS (SELECT dst, coalesce(try_cast(nullif(regexp_extract(dst, '/page/(\d+)', 1), '') AS BIGINT),
    try_cast(nullif(regexp_extract(dst, '[?&]page=(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(dst, '[?&]p=(\d+)', 1), '') AS BIGINT)) AS page FROM e)
    SELECT dst, page, CASE WHEN page IS NULL THEN NULL WHEN contains(dst, '/page/' || page) THEN replace(dst, '/page/' || page, '/page/' || (page + 1))
    WHEN contains(dst, 'page=' || page) THEN replace(dst, 'page=' || page, 'page=' || (page + 1)) WHEN contains(dst, 'p=' || page) THEN replace(dst, 'p=' || page, 'p=' || (page + 1)) END AS next_page FROM n"""
)
def url_page_number(s, d):
    e = table(s, d, "crawl_edges").select("dst").where("dst IS NOT NULL").distinct()
    return e.select("dst", U.page_number(F.col("dst")).alias("page"), U.next_page(F.col("dst")).alias("next_page"))


@query(
    r"""WITH g AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://docs.google.com/document/d/A' || page_id || '/edit' WHEN 1 THEN 'https://docs.google.com/spreadsheets/d/A' || page_id || '/edit#gid=0'
    WHEN 2 THEN 'https://docs.google.com/presentation/d/A' || page_id || '/edit' ELSE 'https://drive.google.com/file/d/A' || page_id || '/view' END AS url FROM crawl_docs)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '/edit', '/export?format=pdf') WHEN 1 THEN 'https://docs.google.com/spreadsheets/d/A' || page_id || '/gviz/tq?tqx=out:html'
    WHEN 2 THEN replace(url, '/edit', '/export/pdf') ELSE 'https://drive.google.com/uc?export=download&id=A' || page_id END AS rewritten FROM g"""
)
def url_rewrite(s, d):
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    made = (
        F.when(k == 0, F.concat(F.lit("https://docs.google.com/document/d/A"), i, F.lit("/edit")))
        .when(k == 1, F.concat(F.lit("https://docs.google.com/spreadsheets/d/A"), i, F.lit("/edit#gid=0")))
        .when(k == 2, F.concat(F.lit("https://docs.google.com/presentation/d/A"), i, F.lit("/edit")))
        .otherwise(F.concat(F.lit("https://drive.google.com/file/d/A"), i, F.lit("/view")))
    )
    return _docs(s, d).select("page_id", U.rewrite_documents(made).alias("rewritten"))


_INCLUDE, _EXCLUDE = ["/docs/*", "/blog/**"], ["**/*tunnel*"]


@query(
    "SELECT page_id, url FROM crawl_docs WHERE (" + " OR ".join(f"regexp_matches({x}, '{U.glob_to_regex(g)}')" for g in _INCLUDE for x in (sql_path("url"), "url")) + ") AND NOT ("
    + " OR ".join(f"coalesce(regexp_matches({x}, '{U.glob_to_regex(g)}'), false)" for g in _EXCLUDE for x in (sql_path("url"), "url")) + ")"
)
def url_glob_filter(s, d):
    return _docs(s, d).where(U.admitted(F.col("url"), _INCLUDE, _EXCLUDE))


@query(
    "SELECT DISTINCT src, dst FROM crawl_edges WHERE dst IS NOT NULL AND " + sql_site("src") + " = " + sql_site("dst") + " AND (" + sql_path("dst") + " = " + sql_path("src")
    + " OR starts_with(" + sql_path("dst") + ", regexp_replace(" + sql_path("src") + ", '/$', '') || '/'))"
)
def url_forward_links(s, d):
    e = table(s, d, "crawl_edges").select("src", "dst").where("dst IS NOT NULL")
    return e.where(U.admit_link(F.col("dst"), F.col("src"))).distinct()


@query(
    "SELECT DISTINCT src, dst FROM crawl_edges WHERE dst IS NOT NULL AND " + sql_site("src") + " = " + sql_site("dst")
)
def url_same_site_links(s, d):
    e = table(s, d, "crawl_edges").select("src", "dst").where("dst IS NOT NULL")
    return e.where(U.admit_link(F.col("dst"), F.col("src"), backward=True)).distinct()


@query(f"SELECT canonical, CAST(min(page_id) AS BIGINT) AS page_id, count(*) AS spellings FROM (SELECT page_id, {sql_canonical('url')} AS canonical FROM crawl_docs) WHERE canonical IS NOT NULL GROUP BY canonical")
def url_dedup_keep_first(s, d):
    c = _docs(s, d).select("page_id", U.canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL")
    return c.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("spellings"))


@query(f"SELECT {sql_site('url')} AS site, count(*) AS pages, count(DISTINCT {sql_canonical('url')}) AS addresses FROM crawl_docs WHERE url IS NOT NULL GROUP BY 1")
def host_counts(s, d):
    c = _docs(s, d).where("url IS NOT NULL").select(U.site(F.col("url")).alias("site"), U.canonical(F.col("url")).alias("c"))
    per = c.groupBy("site", "c").agg(F.count(F.lit(1)).alias("n"))  # two steps: a large site is spread over its addresses
    return per.groupBy("site").agg(F.sum("n").alias("pages"), F.count("c").alias("addresses"))


@query(
    f"WITH c AS (SELECT DISTINCT dst FROM crawl_edges WHERE dst IS NOT NULL) SELECT dst, {_priority_sql('dst', '1')} AS priority FROM c ORDER BY 2 DESC, 1 LIMIT 100"
)
def frontier_topk(s, d):
    e = table(s, d, "crawl_edges").select("dst").where("dst IS NOT NULL").distinct()
    return e.select("dst", U.priority(F.col("dst"), 1).alias("priority")).orderBy(F.desc("priority"), "dst").limit(100)


@query(
    f"""WITH c AS (SELECT DISTINCT {sql_site('dst')} AS site, dst FROM crawl_edges WHERE dst IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dst) AS n FROM c)
    SELECT site, dst, CAST((n - 1) // 2 AS BIGINT) AS at_second FROM r"""
)
def politeness_schedule(s, d):
    from ..operators.evaluate import politeness_schedule as plan

    e = table(s, d, "crawl_edges").select("dst").where("dst IS NOT NULL").distinct()
    return plan(e, U.site(F.col("dst")), ["dst"], 2).select(F.col("host").alias("site"), "dst", "at_second")


@query(
    """SELECT v AS url, w AS private FROM (VALUES ('http://localhost/x', true), ('https://10.0.0.8/', true), ('https://192.168.1.1:80/a', true), ('https://172.20.3.4/', true), ('https://172.40.3.4/', false),
    ('https://a.internal.example/', false), ('ftp://example.org/', true), ('https://vault/secret', true), ('https://x.vault/', true), ('https://169.254.169.254/latest', true), ('https://example.org/10.0.0.1', false), ('http://[::1]/', true), ('http://[::]/x', true), ('http://[fd12:3456::1]:8080/', true), ('http://[fe80::1]/', true), ('http://[febf::1]/', true), ('http://[fec0::1]/', false), ('http://[::ffff:10.0.0.1]/', true), ('http://[::ffff:8.8.8.8]/', false), ('http://[2001:db8::1]/', false), ('http://[fd-x.example/', false)) t(v, w)"""
)
def url_private_targets(s, d):
    urls = [
        "http://localhost/x", "https://10.0.0.8/", "https://192.168.1.1:80/a", "https://172.20.3.4/", "https://172.40.3.4/", "https://a.internal.example/", "ftp://example.org/",
        "https://vault/secret", "https://x.vault/", "https://169.254.169.254/latest", "https://example.org/10.0.0.1",
        "http://[::1]/", "http://[::]/x", "http://[fd12:3456::1]:8080/", "http://[fe80::1]/", "http://[febf::1]/", "http://[fec0::1]/", "http://[::ffff:10.0.0.1]/", "http://[::ffff:8.8.8.8]/", "http://[2001:db8::1]/", "http://[fd-x.example/",
    ]
    return s.createDataFrame([(u,) for u in urls], "url STRING").select("url", U.is_private_target(F.col("url")).alias("private"))


@query(
    "SELECT page_id, regexp_matches(coalesce(l.u, ''), '" + "|".join(t.replace(".", "\\.") for t in U.TRACKERS) + "') AS tracker, l.u AS link FROM (SELECT page_id, unnest(links) AS u FROM crawl_docs) l"
)
def link_trackers(s, d):
    x = table(s, d, "crawl_docs").select("page_id", F.explode("links").alias("link"))
    return x.select("page_id", U.is_tracker(F.col("link")).alias("tracker"), "link")


@query("SELECT cache_id, sha256(url || coalesce(array_to_string(list_transform(headers, lambda h: h.k || chr(1) || h.v), chr(2)), '')) AS key FROM page_cache")
def cache_keys(s, d):
    return table(s, d, "page_cache").select("cache_id", U.cache_key(F.col("url"), F.col("headers")).alias("key"))


@query("SELECT page_id, translate(regexp_replace(url, '^https?://', ''), '/?&=', '____') AS name FROM crawl_docs")
def url_file_names(s, d):
    return _docs(s, d).select("page_id", U.file_name(F.col("url")).alias("name"))
