"""Queries of the remaining operators: predicates, set operations, lookups, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html_text as H
from ..functions import markdown_clean as M
from ..functions import scalars as S
from ..functions import text as T
from ..functions import urls as U
from ..functions.domains import registrable
from .registry import query, sql_any, sql_canonical, sql_host, sql_path, sql_site, sql_trim, table, wide_table

# ---- predicates ------------------------------------------------------------------------

_PARA = "SELECT page_id, unnest(string_split(markdown, chr(10) || chr(10))) AS p, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1) - 1 AS n FROM crawl_docs WHERE markdown IS NOT NULL"


@query(
    f"SELECT page_id, CAST(n AS BIGINT) AS n, coalesce(starts_with(lower(p), 'skip to') OR starts_with(lower(p), 'menu') OR starts_with(lower(p), 'search') OR (octet_length(encode(p)) < 150 AND length(p) - length(replace(p, chr(10), '')) > 5), false) AS navigation FROM ({_PARA})"
)
def navigation_blocks(s, d):
    x = wide_table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", F.posexplode(F.split("markdown", "\n\n")).alias("n", "p"))
    return x.select("page_id", F.col("n").cast("long").alias("n"), T.looks_like_navigation(F.col("p")).alias("navigation"))


def _reg(h: str) -> str:  # hosts of the test tables have suffixes of one label
    return f"CASE WHEN regexp_matches({h}, '[^.]+\\.[^.]+$') THEN regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) ELSE {h} END"


@query(f"SELECT DISTINCT {sql_host('url')} AS host, {_reg(sql_host('url'))} AS registrable FROM crawl_docs WHERE url IS NOT NULL UNION SELECT v, w FROM (VALUES ('a.b.co.uk', 'b.co.uk'), ('user1.github.io', 'user1.github.io'), ('localhost', 'localhost'), ('x.y.city.kawasaki.jp', 'city.kawasaki.jp'), ('a.b.c.kawasaki.jp', 'b.c.kawasaki.jp'), ('10.0.0.1', '10.0.0.1'), ('co.uk', 'co.uk')) t(v, w)")
def host_registrable(s, d):
    h = table(s, d, "crawl_docs").where("url IS NOT NULL").select(U.host(F.col("url")).alias("host")).distinct()
    extra = s.createDataFrame([("a.b.co.uk",), ("user1.github.io",), ("localhost",), ("x.y.city.kawasaki.jp",), ("a.b.c.kawasaki.jp",), ("10.0.0.1",), ("co.uk",)], "host STRING")
    return h.unionByName(extra).select("host", registrable(s, F.col("host")).alias("registrable"))


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM crawl_edges WHERE dst IS NOT NULL AND kind = 'pagination'), n AS (SELECT src, dst, try_cast(nullif(regexp_extract(src, '(?:/page/|[?&]page=|[?&]p=)(\\d+)', 1), '') AS BIGINT) AS a, try_cast(nullif(regexp_extract(dst, '(?:/page/|[?&]page=|[?&]p=)(\\d+)', 1), '') AS BIGINT) AS b FROM e) SELECT src, dst, coalesce(b <= a, false) AS circular FROM n")
def pagination_circular(s, d):
    e = table(s, d, "crawl_edges").where("dst IS NOT NULL AND kind = 'pagination'").select("src", "dst").distinct()
    return e.select("src", "dst", U.is_circular(F.col("dst"), F.col("src")).alias("circular"))


@query("SELECT page_id, url FROM crawl_docs WHERE regexp_matches(url, '/docs/|/api/|/blog/')")
def url_path_filter(s, d):
    return table(s, d, "crawl_docs").select("page_id", "url").where(F.col("url").rlike("/docs/|/api/|/blog/"))


@query("SELECT DISTINCT dst AS url FROM crawl_edges WHERE contains(lower(dst), 'archive') ORDER BY 1 LIMIT 5000")
def map_search_limit(s, d):
    return table(s, d, "crawl_edges").where(F.lower("dst").contains("archive")).select(F.col("dst").alias("url")).distinct().orderBy("url").limit(5000)


@query(
    f"""SELECT page_id, octet_length(encode({sql_trim("coalesce(markdown, '')")})) < 100 AS thin, NOT ({sql_trim("coalesce(markdown, '')")} <> '' AND coalesce(metadata.status_code < 400, true) AND NOT contains(lower(coalesce(title, '')), 'not found')
    AND NOT contains(lower(coalesce(title, '')), '404') AND NOT starts_with(lower(coalesce(metadata.robots, '')), 'noindex')) AS skipped FROM crawl_docs"""
)
def digest_skips(s, d):
    from ..plans.digest import worth_digest

    x = wide_table(s, d, "crawl_docs")
    thin = F.octet_length(T.trim_all(F.coalesce("markdown", F.lit("")))) < 100
    return x.select("page_id", thin.alias("thin"), (~worth_digest(F.col("markdown"), F.col("metadata.status_code"), F.col("title"), F.col("metadata.robots"))).alias("skipped"))


@query(
    f"""SELECT cache_id, {sql_any('html', H.LAZY_MARKS)} OR {sql_any("array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10))", ('IntersectionObserver', 'getBoundingClientRect'))} AS lazy,
    {sql_any('html', H.ROUTER_MARKS)} OR regexp_matches(html, '<a\\s[^>]*href="#/') AS routing FROM page_cache WHERE html IS NOT NULL"""
)
def page_script_signals(s, d):
    h = F.col("html")
    return wide_table(s, d, "page_cache").where("html IS NOT NULL").select("cache_id", H.lazy_loading(h).alias("lazy"), H.script_routing(h).alias("routing"))


@query("SELECT cache_id, regexp_replace(html, '(?is)(<video[^>]*\\sposter=\"([^\"]*)\"[^>]*>)', '\\1<img src=\"\\2\" alt=\"Video poster\">', 'g') = html AS unchanged FROM page_cache WHERE html IS NOT NULL")
def html_video_posters(s, d):
    return wide_table(s, d, "page_cache").where("html IS NOT NULL").select("cache_id", (H.video_posters(F.col("html")) == F.col("html")).alias("unchanged"))


# ---- joins and set operations ----------------------------------------------------------------


@query("SELECT m.metric_id AS metric_id, m.url AS url, c.cache_id AS cache_id, c.status_code AS page_status FROM (SELECT DISTINCT metric_id, url FROM scrape_metrics) m LEFT JOIN (SELECT url, max(cache_id) AS cache_id, arg_max(status_code, cache_id) AS status_code FROM page_cache WHERE url IS NOT NULL GROUP BY url) c ON m.url = c.url")
def search_enrichment(s, d):
    m = table(s, d, "scrape_metrics").select("metric_id", "url").distinct()
    c = table(s, d, "page_cache").where("url IS NOT NULL").groupBy("url").agg(F.max("cache_id").alias("cache_id"), F.max_by("status_code", "cache_id").alias("page_status"))
    return m.join(c, "url", "left").select("metric_id", "url", "cache_id", "page_status")


@query("SELECT DISTINCT metric_id, category FROM scrape_metrics WHERE category IN ('docs', 'news')")
def category_subset(s, d):
    want = s.createDataFrame([("docs",), ("news",)], "category STRING")
    return table(s, d, "scrape_metrics").join(want, "category", "left_semi").select("metric_id", "category").distinct()


@query(f"SELECT c.page_id, r.crawl_delay AS delay FROM crawl_docs c LEFT JOIN (SELECT host, max(crawl_delay) AS crawl_delay FROM site_robots GROUP BY host) r ON {sql_site('c.url')} = r.host OR {sql_host('c.url')} = r.host")
def host_delay_lookup(s, d):
    r = table(s, d, "site_robots").groupBy("host").agg(F.max("crawl_delay").alias("delay"))
    c = table(s, d, "crawl_docs").select("page_id", U.host(F.col("url")).alias("h"), U.site(F.col("url")).alias("site"))
    a = c.join(r, c["site"] == r["host"], "left").select("page_id", "h", "site", F.col("delay").alias("d1"), F.col("host").isNotNull().alias("m1"))
    r2 = r.select(F.col("host").alias("host2"), F.col("delay").alias("d2"))
    b = a.join(r2, (a["h"] == r2["host2"]) & (a["h"] != a["site"]), "left")  # the plain host only where it is another name
    pairs = F.array_compact(F.array(F.when(F.col("m1"), F.struct(F.col("d1").alias("d"))), F.when(F.col("host2").isNotNull(), F.struct(F.col("d2").alias("d")))))
    return b.select("page_id", F.explode_outer(pairs).alias("x")).select("page_id", F.col("x.d").alias("delay"))


@query("SELECT host, content IS NOT NULL AND cached_at >= (SELECT max(cached_at) FROM site_robots) - 86400 AS fresh FROM site_robots")
def robots_cached(s, d):
    r = table(s, d, "site_robots")
    now = r.agg(F.max("cached_at").alias("now"))  # one row
    return r.join(F.broadcast(now)).select("host", (F.col("content").isNotNull() & (F.col("cached_at") >= F.col("now") - 86400)).alias("fresh"))


@query(f"SELECT DISTINCT {sql_canonical('dst')} AS url FROM crawl_edges WHERE dst IS NOT NULL UNION SELECT DISTINCT {sql_canonical('url')} AS url FROM crawl_docs WHERE url IS NOT NULL")
def discovered_union(s, d):
    a = wide_table(s, d, "crawl_edges").where("dst IS NOT NULL").select(U.canonical(F.col("dst")).alias("url"))
    b = table(s, d, "crawl_docs").where("url IS NOT NULL").select(U.canonical(F.col("url")).alias("url"))
    return a.unionByName(b).distinct()


@query(f"SELECT DISTINCT {sql_canonical('dst')} AS url FROM crawl_edges WHERE dst IS NOT NULL EXCEPT SELECT {sql_canonical('url')} AS url FROM crawl_docs WHERE url IS NOT NULL")
def frontier_except_visited(s, d):
    a = wide_table(s, d, "crawl_edges").where("dst IS NOT NULL").select(U.canonical(F.col("dst")).alias("url")).distinct()
    b = table(s, d, "crawl_docs").where("url IS NOT NULL").select(U.canonical(F.col("url")).alias("url")).distinct()
    return a.join(b, "url", "left_anti")


@query(f"SELECT url FROM (SELECT DISTINCT ON (b.url) b.url FROM (SELECT DISTINCT {sql_canonical('url')} AS url FROM scrape_metrics WHERE url IS NOT NULL) b) x WHERE NOT EXISTS (SELECT 1 FROM page_cache p WHERE {sql_canonical('p.url')} = x.url)")
def batch_scrape_missing(s, d):
    want = table(s, d, "scrape_metrics").where("url IS NOT NULL").select(U.canonical(F.col("url")).alias("url")).distinct()
    have = table(s, d, "page_cache").select(U.canonical(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    return want.join(have, "url", "left_anti")


# ---- aggregates and trends ---------------------------------------------------------------------

_OK = "coalesce(success, false)"


@query(f"SELECT count(*) AS total, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN {_OK} THEN 0 ELSE 1 END) AS BIGINT) AS errors FROM scrape_metrics")
def crawl_totals(s, d):
    ok = F.coalesce("success", F.lit(False))
    return table(s, d, "scrape_metrics").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))


@query("SELECT CAST(scraped_at AS DATE) AS day, category, count(*) AS n, round(avg(CAST(success AS INTEGER)), 6) AS ok_rate, round(avg(word_count), 6) AS words FROM scrape_metrics WHERE scraped_at IS NOT NULL GROUP BY 1, 2")
def trend_by_category(s, d):
    m = table(s, d, "scrape_metrics").where("scraped_at IS NOT NULL")
    return m.groupBy(F.to_date("scraped_at").alias("day"), "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("ok_rate"), F.round(F.avg("word_count"), 6).alias("words"))


@query("SELECT test_name, category, round(avg(extraction_ratio), 6) AS ratio, CAST(sum(attempts) AS BIGINT) AS attempts, max(markdown_length) AS longest FROM scrape_metrics GROUP BY ROLLUP (test_name, category)")
def metrics_rollup(s, d):
    m = table(s, d, "scrape_metrics")
    return m.rollup("test_name", "category").agg(F.round(F.avg("extraction_ratio"), 6).alias("ratio"), F.sum("attempts").alias("attempts"), F.max("markdown_length").alias("longest"))




@query("SELECT k, count(*) AS n, count(DISTINCT v) AS values FROM (SELECT unnest(headers).k AS k, unnest(headers).v AS v FROM page_cache) GROUP BY k")
def header_statistics(s, d):
    x = table(s, d, "page_cache").select(F.explode("headers").alias("h")).select("h.k", "h.v")
    return x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("values"))


# ---- Markdown steps one by one -----------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(regexp_replace(markdown, '(?m)^([^\\n]+)\\n={3,}[ \\t]*$', '# \\1', 'g'), '(?m)^([^\\n|#>*+\\-][^\\n]*)\\n-{3,}[ \\t]*$', '## \\1', 'g') AS markdown FROM crawl_docs WHERE markdown IS NOT NULL")
def md_setext(s, d):
    return wide_table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", M.setext_to_atx(F.col("markdown")).alias("markdown"))


@query("SELECT page_id, regexp_replace(markdown, '[ \\t\\n]*\\[\\[edit\\]\\([^)]*\\)\\]', '', 'g') AS a, regexp_replace(markdown, '(?m)^(#{1,6}[ \\t]+[^\\n]+?)[ \\t]+#+[ \\t]*$', '\\1', 'g') AS b FROM crawl_docs WHERE markdown IS NOT NULL")
def md_small_steps(s, d):
    m = F.col("markdown")
    return wide_table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", M.drop_edit_links(m).alias("a"), M.trailing_hashes(m).alias("b"))


@query("SELECT page_id, CASE WHEN NOT regexp_matches(markdown, '(?m)^[ \\t]*#') AND trim(title) <> '' THEN '# ' || trim(title) || chr(10) || chr(10) || markdown ELSE markdown END AS markdown FROM crawl_docs WHERE markdown IS NOT NULL")
def md_title_injection(s, d):
    return wide_table(s, d, "crawl_docs").where("markdown IS NOT NULL").select("page_id", M.title_if_bare(F.col("markdown"), F.coalesce("title", F.lit(""))).alias("markdown"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 300) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 100) END AS head_and_tail FROM documents")
def judge_excerpt(s, d):
    return table(s, d, "documents").select("doc_id", T.judge_excerpt(F.col("text"), 400).alias("head_and_tail"))


# ---- small values ------------------------------------------------------------------------------------------

_ENDPOINTS = {
    "https://api.example/v1": ("https://api.example/v1/chat/completions", "chat"), "https://api.example/v1/chat/completions": ("https://api.example/v1/chat/completions", "chat"),
    "https://api.example/v1/responses/": ("https://api.example/v1/responses", "responses"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _ENDPOINTS.items()) + ") t(base, endpoint, kind)")
def llm_endpoint(s, d):
    x = s.createDataFrame([(k,) for k in _ENDPOINTS], "base STRING")
    return x.select("base", S.llm_endpoint(F.col("base")).alias("e")).select("base", "e.*")


@query("SELECT count(*) AS pages, true AS known FROM crawl_docs WHERE url IS NOT NULL")
def user_agent_choice(s, d):
    """Every page with an address gets an agent of the list, the same at each run."""
    x = table(s, d, "crawl_docs").where("url IS NOT NULL").select(S.user_agent(F.col("url")).alias("agent"))
    return x.agg(F.count("agent").alias("pages"), F.bool_and(F.col("agent").isin(*S.USER_AGENTS)).alias("known"))


@query("SELECT DISTINCT url, url_encode(url) AS encoded, url AS target FROM crawl_docs WHERE url IS NOT NULL")
def search_target(s, d):
    """Each address wrapped as a search engine wraps it, and unwrapped again."""
    x = table(s, d, "crawl_docs").where("url IS NOT NULL").select("url").distinct()
    x = x.withColumn("encoded", U.percent_encode(F.col("url")))
    return x.withColumn("target", U.search_target(F.concat(F.lit("//search.example/l/?uddg="), F.col("encoded"), F.lit("&rut=1"))))


@query("SELECT metric_id, CASE WHEN word_count > 0 THEN word_count ELSE markdown_length // 6 END AS words, coalesce(link_count, 0) AS links, round(coalesce(extraction_ratio, markdown_length / nullif(html_length, 0)), 4) AS ratio FROM (SELECT DISTINCT metric_id, word_count, markdown_length, link_count, extraction_ratio, html_length FROM scrape_metrics)")
def metric_fallbacks(s, d):
    m = table(s, d, "scrape_metrics").select("metric_id", "word_count", "markdown_length", "link_count", "extraction_ratio", "html_length").distinct()
    words = F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(F.floor(F.col("markdown_length") / 6))
    ratio = F.coalesce("extraction_ratio", F.try_divide(F.col("markdown_length"), F.col("html_length")))
    return m.select("metric_id", words.alias("words"), F.coalesce("link_count", F.lit(0)).cast("long").alias("links"), F.round(ratio, 4).alias("ratio"))


@query(f"SELECT page_id, coalesce({sql_path('url')} = '/docs' OR starts_with({sql_path('url')}, '/docs/'), false) AS below FROM crawl_docs")
def url_below_docs(s, d):
    x = table(s, d, "crawl_docs").select("page_id", "url")
    return x.select("page_id", U.is_forward(F.col("url"), F.concat(F.lit("https://"), F.coalesce(U.host(F.col("url")), F.lit("x")), F.lit("/docs"))).alias("below"))


@query()
def search_parse(s, d):
    from ..operators.pages import search_results

    rows = "".join(f'<div class="result"><a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fsite{k}.example%2F">Title {k}</a><a class="result__snippet">About {k}</a></div>' for k in range(12))
    return search_results(s.createDataFrame([(rows,)], "html STRING"), "html", 10)


@query("SELECT code, CAST(n AS BIGINT) AS n FROM (SELECT status_code AS code, count(*) AS n FROM page_cache GROUP BY status_code UNION ALL SELECT metadata.status_code, count(*) FROM crawl_docs GROUP BY 1)")
def status_counts(s, d):
    a = table(s, d, "page_cache").groupBy(F.col("status_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    b = table(s, d, "crawl_docs").groupBy(F.col("metadata.status_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("SELECT DISTINCT error, coalesce(CASE error WHEN 'timeout' THEN 408 WHEN 'not_found' THEN 404 END, 500) AS status FROM scrape_metrics WHERE error IS NOT NULL")
def error_status(s, d):
    return table(s, d, "scrape_metrics").where("error IS NOT NULL").select("error").distinct().select("error", S.status_of(F.col("error")).alias("status"))


# ---- envelopes, language, articles, SQL functions ---------------------------------------------------------------


@query("SELECT cache_id, to_json({'url': url, 'status': status_code}) AS envelope FROM page_cache WHERE url IS NOT NULL AND status_code IS NOT NULL")
def json_envelope(s, d):
    x = table(s, d, "page_cache").where("url IS NOT NULL AND status_code IS NOT NULL")
    return x.select("cache_id", F.to_json(F.struct("url", F.col("status_code").alias("status"))).alias("envelope"))


def _guess_sql() -> str:
    from ..functions.language import COMMON, SCRIPTS

    n = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(chr(39) + v + chr(39) for v in words.split())})))" for k, words in COMMON.items()}
    best = "greatest(" + ", ".join(n.values()) + ")"
    ladder = " ".join(f"WHEN {n[k]} = {best} THEN '{k}'" for k in sorted(n, reverse=True))
    scripts = " ".join(f"WHEN length(regexp_replace(text, '[^{r}]', '', 'g')) * 5 > length(text) THEN '{k}'" for k, r in SCRIPTS.items())
    return f"SELECT doc_id, CASE {scripts} WHEN {best} >= 3 THEN CASE {ladder} END END AS lang FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents)"


@query(_guess_sql())
def doc_language_guess(s, d):
    from ..functions.language import guess

    return wide_table(s, d, "documents").select("doc_id", guess(F.col("text")).alias("lang"))


@query()
def html_article(s, d):
    from ..operators.pages import article

    return article(table(s, d, "page_cache"), "cache_id", "html").withColumnRenamed("row_id", "cache_id")


@query()
def sql_functions(s, d):
    from ..plans.sql import register

    register(s)
    table(s, d, "page_cache").createOrReplaceTempView("pagelake_page_cache")
    return s.sql("""SELECT cache_id, length(html_to_markdown(html, url)) AS n, css_extract(html, '{"h": "h1"}') AS h, size(pagination_links(html, url)) AS pages FROM pagelake_page_cache""")
