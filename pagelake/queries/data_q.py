"""Queries over edges, robots files, metrics and events."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import urls as U
from ..operators import evaluate as E
from .registry import query, sql_canonical, sql_host, sql_site, table, wide_table

# ---- graph ------------------------------------------------------------------------------

_EDGES = f"SELECT DISTINCT {sql_canonical('src')} AS s, {sql_canonical('dst')} AS d FROM crawl_edges WHERE dst IS NOT NULL"
_SEED = f"SELECT {sql_canonical('url')} AS url FROM crawl_docs WHERE url IS NOT NULL ORDER BY page_id LIMIT 1"


def _edges(s, d):
    e = wide_table(s, d, "crawl_edges").where("dst IS NOT NULL")
    return e.select(U.canonical(F.col("src")).alias("src"), U.canonical(F.col("dst")).alias("dst"), "kind", "pos").where("src IS NOT NULL")


def _seed(s, d):
    return table(s, d, "crawl_docs").where("url IS NOT NULL").orderBy("page_id").limit(1).select(U.canonical(F.col("url")).alias("url"))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), seed AS ({_SEED}), r(url, depth) AS (SELECT url, 0 FROM seed UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON r.url = e.s WHERE r.depth < 3)
    SELECT url, min(depth) AS depth FROM r GROUP BY url"""
)
def graph_reachability(s, d):
    from ..operators.graph import reachable

    return reachable(_edges(s, d), _seed(s, d), 3)


@query(
    f"WITH e AS ({_EDGES}), i AS (SELECT d AS url, count(*) AS n FROM e GROUP BY d), o AS (SELECT s AS url, count(*) AS n FROM e GROUP BY s) SELECT coalesce(i.url, o.url) AS url, CAST(coalesce(i.n, 0) AS BIGINT) AS n_in, CAST(coalesce(o.n, 0) AS BIGINT) AS n_out FROM i FULL JOIN o ON i.url = o.url"
)
def graph_degrees(s, d):
    from ..operators.graph import degrees

    return degrees(_edges(s, d))


@query(f"SELECT DISTINCT d AS url FROM ({_EDGES}) e WHERE NOT EXISTS (SELECT 1 FROM crawl_docs c WHERE {sql_canonical('c.url')} = e.d)")
def link_antijoin_visited(s, d):
    seen = table(s, d, "crawl_docs").select(U.canonical(F.col("url")).alias("dst")).where("dst IS NOT NULL").distinct()
    return _edges(s, d).select("dst").distinct().join(seen, "dst", "left_anti").select(F.col("dst").alias("url"))


@query(f"WITH e AS (SELECT DISTINCT {sql_canonical('src')} AS s, {sql_canonical('dst')} AS d, kind FROM crawl_edges WHERE dst IS NOT NULL) SELECT s AS src, d AS dst FROM e WHERE kind = 'link' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.kind = 'pagination' AND p.s = e.s AND p.d = e.d)")
def link_without_pagination(s, d):
    e = _edges(s, d).select("src", "dst", "kind").distinct()
    pages = e.where("kind = 'pagination'").select("src", "dst")
    return e.where("kind = 'link'").select("src", "dst").join(pages, ["src", "dst"], "left_anti")


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {sql_canonical('src')} AS s, {sql_canonical('dst')} AS d FROM crawl_edges WHERE dst IS NOT NULL AND kind = 'pagination'),
    r(seed, url, pos) AS (SELECT s, s, 0 FROM e UNION SELECT r.seed, e.d, r.pos + 1 FROM r JOIN e ON r.url = e.s WHERE r.pos < 10) SELECT seed, url, min(pos) AS pos FROM r GROUP BY seed, url"""
)
def pagination_chain(s, d):
    from ..operators.graph import follow_chain

    e = _edges(s, d).where("kind = 'pagination'")
    return follow_chain(e, e.select(F.col("src").alias("url")), max_pages=None)  # all pages; tests hold the bound of 50


@query()
def crawl_priority(s, d):
    from ..options import CrawlOptions
    from ..plans.crawl import crawl

    docs = table(s, d, "crawl_docs").select("url", "markdown", F.col("metadata.status_code").alias("status_code"))
    start = [r.url for r in _seed(s, d).collect()]
    return crawl(docs, table(s, d, "crawl_edges"), start, CrawlOptions(max_depth=2, limit=200, batch=100, allow_external_links=True))


@query(
    f"WITH t AS (SELECT {_SEED.replace('SELECT ', '', 1)}) SELECT DISTINCT dst AS url FROM crawl_edges, t WHERE dst IS NOT NULL AND {sql_site('src')} = {sql_site('t.url')} AND {sql_site('dst')} = {sql_site('t.url')} ORDER BY 1 LIMIT 5000"
)
def map_discover(s, d):
    from ..options import MapOptions
    from ..plans.digest import map_urls

    site = _seed(s, d).collect()[0].url
    return map_urls(table(s, d, "crawl_edges"), None, site, MapOptions(include_subdomains=False, limit=500))


@query()
def llmstxt_digest(s, d):
    from ..options import DigestOptions
    from ..plans.digest import llmstxt

    return llmstxt(table(s, d, "crawl_docs"), DigestOptions(max_urls=20))


@query(
    f"""WITH g AS (SELECT page_id, url, {sql_site('url')} AS site, coalesce(nullif(trim(title), ''), nullif(trim(metadata.og_title), ''), nullif(split_part(regexp_replace(url, '/+$', ''), '/', -1), ''), 'Untitled') AS t,
    substring(coalesce(nullif(trim(description), ''), nullif(trim(metadata.og_description), ''), 'No description available'), 1, 150) AS x FROM crawl_docs WHERE url IS NOT NULL AND trim(coalesce(markdown, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''
    AND coalesce(metadata.status_code < 400, true) AND NOT contains(lower(coalesce(title, '')), 'not found') AND NOT contains(lower(coalesce(title, '')), '404') AND NOT starts_with(lower(coalesce(metadata.robots, '')), 'noindex')),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN {sql_host('url')} = site THEN 0 ELSE 1 END, url, page_id) AS n FROM g)
    SELECT site, '# https://' || site || chr(10) || chr(10) || string_agg('- [' || t || '](' || url || '): ' || x || chr(10), '' ORDER BY n) AS llmstxt, count(*) AS urls FROM r WHERE n <= 20 AND site IS NOT NULL GROUP BY site"""
)
def llmstxt_index(s, d):
    from ..options import DigestOptions
    from ..plans.digest import llmstxt

    return llmstxt(table(s, d, "crawl_docs"), DigestOptions(max_urls=20, show_full_text=False)).select("site", "llmstxt", F.col("urls_processed").alias("urls"))


# ---- robots and sitemaps ------------------------------------------------------------------


@query(
    r"""SELECT host, trim(regexp_extract(l, '^[^:]+:(.*)$', 1)) AS sitemap FROM (SELECT host, trim(regexp_replace(regexp_replace(unnest(string_split(content, chr(10))), '#.*$', ''), '\r', '', 'g')) AS l FROM site_robots)
    WHERE lower(l) LIKE 'sitemap:%' AND trim(regexp_extract(l, '^[^:]+:(.*)$', 1)) <> ''"""
)
def robots_sitemaps(s, d):
    from ..operators.robots import sitemap_directives

    return sitemap_directives(table(s, d, "site_robots"), "host", "content")


@query(
    r"""WITH l AS (SELECT host, content, lower(trim(regexp_replace(regexp_replace(unnest(string_split(content, chr(10))), '#.*$', ''), '\r', '', 'g'))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM site_robots),
    a AS (SELECT *, max(CASE WHEN starts_with(l, 'user-agent:') THEN i END) OVER (PARTITION BY host, content ORDER BY i) AS ai FROM l),
    g AS (SELECT a.*, trim(regexp_extract(u.l, '^user-agent:(.*)$', 1)) AS who FROM a LEFT JOIN l u ON u.host = a.host AND u.content = a.content AND u.i = a.ai),
    v AS (SELECT host, content, i, try_cast(nullif(regexp_extract(l, '^crawl-delay:\s*([0-9]+(?:\.[0-9]+)?)\s*$', 1), '') AS DOUBLE) AS d FROM g WHERE who = '*' OR (who <> '' AND contains('patientbot', who)))
    SELECT r.host, (SELECT arg_max(v.d, v.i) FROM v WHERE v.host = r.host AND v.content = r.content AND v.d IS NOT NULL) AS delay FROM site_robots r"""
)
def robots_crawl_delay(s, d):
    from ..operators.robots import crawl_delay_column

    return table(s, d, "site_robots").select("host", crawl_delay_column(F.col("content"), "PatientBot").alias("delay"))


@query()
def robots_gate(s, d):
    from ..operators.robots import robots_gate as gate

    return gate(table(s, d, "crawl_docs").select("page_id", "url"), table(s, d, "site_robots"))


_SITEMAPS = [
    ("https://a.example/sitemap.xml", "<sitemapindex><sitemap><loc> https://a.example/s1.xml </loc></sitemap><sitemap><loc>https://a.example/s2.xml</loc></sitemap></sitemapindex>"),
    ("https://a.example/s1.xml", "<urlset><url><loc>https://a.example/1</loc></url><url><loc>https://a.example/2</loc><lastmod>2024-01-01</lastmod></url></urlset>"),
    ("https://a.example/s2.xml", "<sitemapindex><sitemap><loc>https://a.example/s3.xml</loc></sitemap><sitemap><loc>https://a.example/sitemap.xml</loc></sitemap></sitemapindex>"),
    ("https://a.example/s3.xml", "https://a.example/3\nnot an address\nhttps://a.example/1"),
    ("https://b.example/sitemap.xml", "<urlset><url><loc>https://b.example/1</loc></url></urlset>"),
]


def _values(rows: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in r) + ")" for r in rows) + ")"


_ENTRIES = (
    "SELECT DISTINCT sitemap, kind, trim(loc) AS loc FROM (SELECT sitemap, CASE WHEN contains(body, '<sitemapindex') THEN 'sitemap' ELSE 'page' END AS kind, unnest(CASE WHEN contains(body, '<sitemapindex') THEN"
    " regexp_extract_all(body, '(?s)<sitemap[^>]*>.*?<loc>([^<]+)</loc>.*?</sitemap>', 1) WHEN contains(body, '<urlset') THEN regexp_extract_all(body, '(?s)<url[^>]*>.*?<loc>([^<]+)</loc>.*?</url>', 1)"
    f" ELSE list_filter(string_split(body, chr(10)), lambda x: starts_with(trim(x), 'http')) END) AS loc FROM {_values(_SITEMAPS)} t(sitemap, body))"
)


@query(_ENTRIES)
def sitemap_parse(s, d):
    from ..operators.robots import sitemap_entries

    return sitemap_entries(s.createDataFrame(_SITEMAPS, "url STRING, body STRING"), "url", "body")


@query(
    f"WITH RECURSIVE e AS ({_ENTRIES}), r(sitemap, depth) AS (SELECT 'https://a.example/sitemap.xml', 0 UNION SELECT e.loc, r.depth + 1 FROM r JOIN e ON e.sitemap = r.sitemap AND e.kind = 'sitemap' WHERE r.depth < 5) SELECT DISTINCT e.loc AS url FROM e JOIN r ON e.sitemap = r.sitemap WHERE e.kind = 'page'"
)
def sitemap_recursive(s, d):
    from ..operators.robots import expand_sitemaps, sitemap_entries

    e = sitemap_entries(s.createDataFrame(_SITEMAPS, "url STRING, body STRING"), "url", "body")
    return expand_sitemaps(e, s.createDataFrame([("https://a.example/sitemap.xml",)], "sitemap STRING"))


# ---- metrics -------------------------------------------------------------------------------

_OK = "coalesce(success, false)"


@query(
    f"""SELECT category, count(*) AS n, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS n_success, round(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS success_rate, round(avg(response_time_ms), 6) AS avg_ms,
    min(response_time_ms) AS min_ms, max(response_time_ms) AS max_ms, round(avg(markdown_length), 6) AS avg_markdown_length, CAST(sum(link_count) AS BIGINT) AS links, CAST(sum(image_count) AS BIGINT) AS images,
    CAST(sum(word_count) AS BIGINT) AS words FROM (SELECT DISTINCT * FROM scrape_metrics) GROUP BY category"""
)
def metrics_summary(s, d):
    return E.summary(table(s, d, "scrape_metrics").distinct(), ["category"])


def _pct(p: float) -> str:
    return f"list_sort(list(response_time_ms))[CAST(floor({p} * (count(response_time_ms) - 1) + 0.5) AS INTEGER) + 1]"


@query(f"SELECT category, {_pct(0.5)} AS p50, {_pct(0.9)} AS p90, {_pct(0.99)} AS p99 FROM scrape_metrics WHERE response_time_ms IS NOT NULL GROUP BY category")
def latency_percentiles(s, d):
    return E.percentiles(table(s, d, "scrape_metrics"), "response_time_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["category"])


@query("SELECT category, round(var_pop(CAST(response_time_ms AS DOUBLE)), 4) AS variance, round(stddev_pop(CAST(response_time_ms AS DOUBLE)), 6) AS deviation, round(stddev_pop(CAST(response_time_ms AS DOUBLE)) / nullif(avg(CAST(response_time_ms AS DOUBLE)), 0), 6) AS variation FROM scrape_metrics GROUP BY category")
def latency_variance(s, d):
    return E.latency_spread(table(s, d, "scrape_metrics"), ["category"])


@query("SELECT url, count(*) AS runs, count(DISTINCT content_hash) AS contents FROM scrape_metrics WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1 AND count(DISTINCT content_hash) > 1")
def drift_detection(s, d):
    return E.content_drift(table(s, d, "scrape_metrics"))


def _parity_sql() -> str:
    side = "SELECT DISTINCT url, metric_id, success, response_time_ms, content_hash, markdown_length FROM scrape_metrics m WHERE engine_tag = '{t}' AND url IS NOT NULL AND metric_id = (SELECT max(metric_id) FROM scrape_metrics k WHERE k.engine_tag = '{t}' AND k.url = m.url)"
    x, y = "x.response_time_ms", "y.response_time_ms"
    band = f"floor(greatest({x}, {y}) * 0.2)"
    return (
        f"WITH x AS ({side.format(t='http')}), y AS ({side.format(t='browser')}) SELECT x.url AS url, coalesce(x.content_hash = y.content_hash, false) AS same_content, (coalesce(x.success, false) AND coalesce(y.success, false)) AS both_ok,"
        f" {x} - {y} AS ms_delta, x.markdown_length - y.markdown_length AS length_delta, CASE WHEN {x} + {band} < {y} THEN 'a' WHEN {y} + {band} < {x} THEN 'b' ELSE 'tie' END AS speed_winner FROM x JOIN y ON x.url = y.url"
    )


@query(_parity_sql())
def engine_parity(s, d):
    return E.engine_parity(table(s, d, "scrape_metrics"), "http", "browser")


@query(f"SELECT count(*) AS pairs, round(100.0 * count_if(same_content) / count(*), 6) AS match_rate, round(100.0 * count_if(both_ok) / count(*), 6) AS both_ok_rate, round(avg(ms_delta), 6) AS avg_ms_delta FROM ({_parity_sql()})")
def engine_parity_summary(s, d):
    return E.parity_summary(E.engine_parity(table(s, d, "scrape_metrics"), "http", "browser"))


_DIMS = ["success", "has_title", "has_description"]


@query(" UNION ALL ".join(f"SELECT category, test_name, '{f}' AS dimension, round(avg(CAST({f} AS INTEGER)), 6) AS rate, count({f}) AS n FROM scrape_metrics GROUP BY category, test_name" for f in _DIMS))
def eval_dimension_rates(s, d):
    return E.unpivot_rates(table(s, d, "scrape_metrics"), ["category", "test_name"], _DIMS)


@query("WITH d AS (SELECT CAST(scraped_at AS DATE) AS day, round(avg(response_time_ms), 6) AS mean, count(*) AS n FROM scrape_metrics WHERE scraped_at IS NOT NULL GROUP BY 1) SELECT *, round(mean - lag(mean) OVER (ORDER BY day), 6) AS change FROM d")
def eval_trends(s, d):
    return E.daily_trend(table(s, d, "scrape_metrics"), "scraped_at", "response_time_ms")


@query("SELECT DISTINCT metric_id, url, category, success FROM scrape_metrics WHERE CAST(scraped_at AS DATE) = (SELECT max(CAST(scraped_at AS DATE)) FROM scrape_metrics)")
def eval_latest_run(s, d):
    m = table(s, d, "scrape_metrics")
    last = m.agg(F.max(F.to_date("scraped_at")).alias("last"))
    return m.join(F.broadcast(last), F.to_date("scraped_at") == F.col("last")).select("metric_id", "url", "category", "success").distinct()  # one row is broadcast


def _speed_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 1000 THEN 10.0 WHEN {x} <= 2000 THEN 9.0 WHEN {x} <= 3000 THEN 8.0 WHEN {x} <= 5000 THEN 7.0 WHEN {x} <= 8000 THEN 5.0 WHEN {x} <= 15000 THEN 3.0 WHEN {x} <= 30000 THEN 1.0 ELSE 0.0 END"


def _complete_sql(ok: str, w: str, e: int) -> str:
    r = f"({w} / {float(e)})"
    return f"CASE WHEN {ok} THEN CASE WHEN {r} >= 2 THEN 10.0 WHEN {r} >= 1.5 THEN 9.0 WHEN {r} >= 1 THEN 8.0 WHEN {r} >= 0.75 THEN 6.0 WHEN {r} >= 0.5 THEN 4.0 WHEN {r} >= 0.25 THEN 2.0 ELSE 1.0 END ELSE 0.0 END"


@query(f"SELECT DISTINCT metric_id, CAST({_speed_sql('response_time_ms')} AS DOUBLE) AS speed, CAST({_complete_sql('success', 'word_count', 500)} AS DOUBLE) AS completeness FROM scrape_metrics")
def metric_scores(s, d):
    m = table(s, d, "scrape_metrics")
    return m.select("metric_id", S.speed_score(F.col("response_time_ms")).alias("speed"), S.completeness_score(F.col("success"), F.col("word_count"), 500).alias("completeness")).distinct()


_QUALITY = """CASE WHEN octet_length(encode(markdown)) > 0 AND coalesce(metadata.status_code < 400, false) THEN greatest(least(5.0 + CASE WHEN w > 500 THEN 1.0 ELSE 0 END + CASE WHEN w > 1000 THEN 0.5 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 0.5 ELSE 0 END
    + CASE WHEN description IS NOT NULL THEN 0.5 ELSE 0 END - CASE WHEN tags / greatest(octet_length(encode(markdown)), 1) > 0.01 THEN 2.0 WHEN tags / greatest(octet_length(encode(markdown)), 1) > 0.001 THEN 1.0 ELSE 0 END
    - CASE WHEN contains(markdown, repeat(chr(10), 4)) THEN 0.5 ELSE 0 END - CASE WHEN metadata.content_script_ratio < 0.05 AND w < 200 THEN 1.5 WHEN metadata.content_script_ratio < 0.1 AND w < 200 THEN 0.5 ELSE 0 END
    + CASE WHEN coalesce(len(links), 0) > 5 THEN 0.5 ELSE 0 END + CASE WHEN contains(markdown, '# ') THEN 0.5 ELSE 0 END + CASE WHEN contains(markdown, '```') THEN 0.5 ELSE 0 END + CASE WHEN coalesce(len(images), 0) > 0 THEN 0.5 ELSE 0 END
    + CASE WHEN tags = 0 AND octet_length(encode(markdown)) > 100 THEN 0.5 ELSE 0 END, 10.0), 0.0) ELSE 0.0 END"""


@query(
    f"SELECT page_id, round(CAST({_QUALITY} AS DOUBLE), 6) AS score FROM (SELECT *, len(list_filter(regexp_split_to_array(markdown, '[ \\t\\r\\n\\f]+'), lambda x: x <> '')) AS w, (length(markdown) - length(replace(markdown, '</', ''))) // 2 AS tags FROM crawl_docs)"
)
def quality_score(s, d):
    from ..functions.text import word_count

    x = table(s, d, "crawl_docs")
    md = F.col("markdown")
    score = S.markdown_quality(
        F.col("metadata.status_code") < 400, word_count(md), F.col("title").isNotNull(), F.col("description").isNotNull(), md, F.col("metadata.content_script_ratio"),
        F.coalesce(F.size("links"), F.lit(0)), F.coalesce(F.size("images"), F.lit(0)),
    )
    return x.select("page_id", F.round(score, 6).alias("score"))


def _wins(kind: str, a: str, b: str) -> str:
    band = f"floor(greatest(greatest({a}, {b}) * 0.1, 1.0))"
    if kind == "higher":
        return f"CASE WHEN {a} > {b} + {band} THEN 'a' WHEN {b} > {a} + {band} THEN 'b' ELSE 'tie' END"
    sp = f"floor(greatest({a}, {b}) * 0.2)"
    return f"CASE WHEN {a} + {sp} < {b} THEN 'a' WHEN {b} + {sp} < {a} THEN 'b' ELSE 'tie' END"


def _score(k: str, w: str) -> str:
    return f"CASE WHEN {w} = 'a' THEN {S.WEIGHTS[k]} WHEN {w} = 'b' THEN -{S.WEIGHTS[k]} ELSE 0.0 END"


_PAIR = (
    "SELECT x.url, x.category, x.word_count AS aw, y.word_count AS bw, x.link_count AS al, y.link_count AS bl, x.image_count AS ai, y.image_count AS bi, x.response_time_ms AS am, y.response_time_ms AS bm"
    " FROM (SELECT DISTINCT * FROM scrape_metrics m WHERE engine_tag = 'http' AND url IS NOT NULL AND metric_id = (SELECT max(metric_id) FROM scrape_metrics k WHERE k.engine_tag = 'http' AND k.url = m.url)) x"
    " JOIN (SELECT DISTINCT * FROM scrape_metrics m WHERE engine_tag = 'browser' AND url IS NOT NULL AND metric_id = (SELECT max(metric_id) FROM scrape_metrics k WHERE k.engine_tag = 'browser' AND k.url = m.url)) y ON x.url = y.url"
)
_WINNERS = f"SELECT url, category, {_wins('higher', 'aw', 'bw')} AS words, {_wins('higher', 'al', 'bl')} AS links, {_wins('higher', 'ai', 'bi')} AS images, {_wins('speed', 'am', 'bm')} AS speed FROM ({_PAIR})"


def _winners(s, d):
    m = table(s, d, "scrape_metrics").where("url IS NOT NULL")
    cols = ("category", "word_count", "link_count", "image_count", "response_time_ms")
    last = F.max_by(F.struct(*cols), F.col("metric_id")).alias("r")
    x = m.where("engine_tag = 'http'").groupBy("url").agg(last).select("url", "r.*")
    y = m.where("engine_tag = 'browser'").groupBy("url").agg(last).select("url", *[F.col(f"r.{c}").alias(f"b_{c}") for c in cols])
    j = x.join(y, "url")
    return j.select(
        "url", "category", S.winner_higher(F.col("word_count"), F.col("b_word_count")).alias("words"), S.winner_higher(F.col("link_count"), F.col("b_link_count")).alias("links"),
        S.winner_higher(F.col("image_count"), F.col("b_image_count")).alias("images"), S.winner_speed(F.col("response_time_ms"), F.col("b_response_time_ms")).alias("speed"),
    )


@query(_WINNERS)
def eval_winners(s, d):
    return _winners(s, d)


_ADV = "(" + " + ".join(_score(k, k) for k in ("words", "links", "images", "speed")) + f") / {sum(S.WEIGHTS.values())}"


@query(f"SELECT url, round(CAST({_ADV} AS DOUBLE), 6) AS advantage, CASE WHEN {_ADV} > 0.05 THEN 'a' WHEN {_ADV} < -0.05 THEN 'b' ELSE 'tie' END AS winner FROM ({_WINNERS})")
def eval_overall(s, d):
    w = _winners(s, d)
    adv = S.advantage({k: F.col(k) for k in ("words", "links", "images", "speed")})
    return w.select("url", F.round(adv, 6).alias("advantage"), S.overall_winner(adv).alias("winner"))


@query(f"SELECT category, count(*) AS pairs, round(100.0 * count_if(speed = 'a') / count(*), 6) AS speed_rate, round(100.0 * count_if(words = 'a') / count(*), 6) AS words_rate FROM ({_WINNERS}) GROUP BY category")
def eval_category(s, d):
    n = F.count(F.lit(1))
    return _winners(s, d).groupBy("category").agg(
        n.alias("pairs"), F.round(100.0 * F.count_if(F.col("speed") == "a") / n, 6).alias("speed_rate"), F.round(100.0 * F.count_if(F.col("words") == "a") / n, 6).alias("words_rate")
    )


@query(
    f"SELECT DISTINCT metric_id, url, ({_speed_sql('response_time_ms')} + {_complete_sql('success', 'word_count', 500)} + 10.0) / 3 AS overall FROM scrape_metrics WHERE success AND response_time_ms IS NOT NULL AND word_count IS NOT NULL"
    " ORDER BY overall, metric_id LIMIT 5"
)
def bottom_five(s, d):
    m = table(s, d, "scrape_metrics").where("success AND response_time_ms IS NOT NULL AND word_count IS NOT NULL")
    parts = S.speed_score(F.col("response_time_ms")) + S.completeness_score(F.col("success"), F.col("word_count"), 500) + S.reliability_score(F.col("success"))
    return m.select("metric_id", "url", (parts / 3).alias("overall")).distinct().orderBy("overall", "metric_id").limit(5)


@query("SELECT DISTINCT metric_id, error, coalesce(regexp_matches(lower(error), 'timeout|timed out|connection|request'), false) AS transient FROM scrape_metrics WHERE NOT success")
def failures(s, d):
    m = table(s, d, "scrape_metrics").where("NOT success")
    return m.select("metric_id", "error", S.is_transient(F.col("error")).alias("transient")).distinct()


# ---- events: breaker, limits, caches -----------------------------------------------------------

_EV = "SELECT event_id, ts, user_id, event_type FROM events"


@query(
    f"WITH e AS ({_EV}), g AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) AS good FROM e GROUP BY user_id) SELECT CAST(e.user_id AS BIGINT) AS key, CAST(sum(CASE WHEN event_type = 'error' AND (good IS NULL OR (ts, event_id) > good) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM e JOIN g ON e.user_id = g.user_id GROUP BY 1"
)
def breaker_trailing_failures(s, d):
    return E.trailing_failures(table(s, d, "events"), "user_id", F.col("event_type") != "error", ["ts", "event_id"])


@query("SELECT minute, user_id, n FROM (SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1")
def limiter_per_minute(s, d):
    e = table(s, d, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.where("n > 1")


_HITS = "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < 3600000000, false) AS hit FROM events"


@query(_HITS)
def ttl_cache_hits(s, d):
    return E.cache_hits(table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600).select("event_id", "hit")


@query(f"SELECT count(*) AS looks, count_if(hit) AS hits, round(count_if(hit) / count(*), 6) AS rate FROM ({_HITS})")
def cache_hit_rate(s, d):
    h = E.cache_hits(table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600)
    return h.agg(F.count(F.lit(1)).alias("looks"), F.count_if("hit").alias("hits"), F.round(F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("rate"))


# ---- streams: run over what is there, compared with their batch twins ------------------------------


def _folder(s) -> str:
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or os.path.join("/tmp", "pagelake-streams")  # one machine, as in tests
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _stream(s, d, name: str):
    path = f"{d}/{name}.parquet"
    batch = s.read.parquet(path)
    folder = path if not path.endswith(".parquet") or _is_dir(s, path) else None
    src = s.readStream.schema(batch.schema)
    return src.parquet(folder) if folder else src.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _is_dir(s, path: str) -> bool:
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(s._jsc.hadoopConfiguration())
    return bool(fs.getFileStatus(p).isDirectory())


def _with_time(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('minute', ts) AS minute, CAST(user_id AS BIGINT) AS key, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    from ..streaming.stateful import per_minute, run_available

    out = run_available(per_minute(_with_time(_stream(s, d, "events")), "user_id", "ts", 1), _folder(s), "update")
    last = out.groupBy("minute", "key").agg(F.max_by(F.struct("n", "limited"), F.col("__batch")).alias("x"))
    return last.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "key", "x.n", "x.limited")


@query(
    f"WITH e AS ({_EV}), g AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) AS good FROM e GROUP BY user_id), n AS (SELECT e.user_id, sum(CASE WHEN event_type = 'error' AND (good IS NULL OR (ts, event_id) > good) THEN 1 ELSE 0 END) AS n FROM e JOIN g ON e.user_id = g.user_id GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS key, CAST(n AS BIGINT) AS failures, n >= 3 AS is_open FROM n"
)
def stream_breaker(s, d):
    from ..streaming.stateful import circuit_breaker, run_available

    out = run_available(circuit_breaker(_stream(s, d, "events"), F.col("user_id"), F.col("event_type") != "error", "ts", "event_id"), _folder(s), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("failures", "is_open"), F.col("__batch")).alias("x"))
    return last.select("key", "x.failures", "x.is_open")


@query(
    f"WITH e AS ({_EV}), g AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) AS good, max(ts) AS latest FROM e GROUP BY user_id), n AS (SELECT e.user_id, any_value(latest) AS latest, sum(CASE WHEN event_type = 'error' AND (good IS NULL OR (ts, event_id) > good) THEN 1 ELSE 0 END) AS n,"
    " max(CASE WHEN event_type = 'error' AND (good IS NULL OR (ts, event_id) > good) THEN ts END) AS last FROM e JOIN g ON e.user_id = g.user_id GROUP BY 1)"
    " SELECT CAST(user_id AS VARCHAR) AS key, CAST(n AS BIGINT) AS failures, n >= 3 AND NOT coalesce(epoch_us(latest) - epoch_us(last) >= 0, false) AS is_open, n >= 3 AND coalesce(epoch_us(latest) - epoch_us(last) >= 0, false) AS half_open FROM n"
)
def stream_breaker_half_open(s, d):
    from ..streaming.stateful import circuit_breaker, run_available

    out = run_available(circuit_breaker(_stream(s, d, "events"), F.col("user_id"), F.col("event_type") != "error", "ts", "event_id", 3, 0.0), _folder(s), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("failures", "is_open", "half_open"), F.col("__batch")).alias("x"))
    return last.select("key", "x.failures", "x.is_open", "x.half_open")


@query(_HITS.replace("SELECT event_id", "SELECT CAST(event_id AS BIGINT) AS seq"))
def stream_ttl_cache(s, d):
    from ..streaming.stateful import run_available, ttl_lookups

    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type"))
    return run_available(ttl_lookups(_stream(s, d, "events"), key, "ts", "event_id", 3600), _folder(s)).select("seq", "hit")


@query()
def stream_token_bucket(s, d):
    from ..streaming.stateful import run_available, token_bucket

    return run_available(token_bucket(_stream(s, d, "events"), F.col("user_id"), "ts", "event_id"), _folder(s)).select("key", "seq", "allowed", "wait_ms")


@query("SELECT cache_id IS NOT NULL AS kept, count(DISTINCT html) AS n FROM page_cache WHERE html IS NOT NULL AND url IS NOT NULL GROUP BY 1")
def stream_dedup(s, d):
    """Every content once within a day of its time; all pages come in one batch."""
    from ..streaming.stateful import distinct_contents, run_available

    pages = _stream(s, d, "page_cache").where("html IS NOT NULL AND url IS NOT NULL").withColumn("at", F.timestamp_seconds("cached_at"))
    out = run_available(distinct_contents(pages, "html", "at", "1 day", normal=False).select("cache_id", "content_key"), _folder(s))
    return out.groupBy(F.col("cache_id").isNotNull().alias("kept")).agg(F.count("content_key").alias("n"))


@query()
def stream_sessions(s, d):
    from ..streaming.stateful import run_available, sessions

    return run_available(sessions(_with_time(_stream(s, d, "events")), "user_id", "ts"), _folder(s)).drop("__batch", "batch")


@query(
    "SELECT 'status' AS type, url, count(*) AS n FROM page_cache GROUP BY url UNION ALL SELECT CASE WHEN coalesce(status_code, 200) < 400 THEN 'document' ELSE 'error' END AS type, url, count(*) AS n FROM page_cache GROUP BY 1, 2"
)
def stream_events(s, d):
    from ..streaming.stateful import page_events, run_available

    p = _stream(s, d, "page_cache").select("url", F.lit(None).cast("string").alias("title"), F.when(F.coalesce(F.col("status_code"), F.lit(200)) >= 400, F.lit("failed")).alias("error"))
    return run_available(page_events(p), _folder(s)).groupBy("type", "url").agg(F.count(F.lit(1)).alias("n"))


# ---- plain relational twins over the star schema -----------------------------------------------------


@query(
    """SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2"""
)
def join_star(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(s, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)).alias("revenue_cents"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_customers(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_flags(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def window_rank_orders(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query(f"SELECT {sql_site('url')} AS host FROM crawl_docs WHERE url IS NOT NULL INTERSECT SELECT host FROM site_robots EXCEPT SELECT host FROM site_robots WHERE content IS NULL")
def setops_hosts(s, d):
    a = table(s, d, "crawl_docs").where("url IS NOT NULL").select(U.site(F.col("url")).alias("host"))
    r = table(s, d, "site_robots")
    return a.intersect(r.select("host")).exceptAll(r.where("content IS NULL").select("host").distinct())


@query(
    f"SELECT {sql_site('url')} AS site, count(*) AS pages, count(DISTINCT {sql_canonical('url')}) AS addresses, round(avg(len(list_filter(regexp_split_to_array(coalesce(markdown, ''), '[ \\t\\r\\n\\f]+'), lambda x: x <> ''))), 6) AS avg_words, min({sql_canonical('url')}) AS first_url FROM crawl_docs WHERE {sql_site('url')} IS NOT NULL GROUP BY 1"
)
def flagship(s, d):
    from ..functions.text import word_count

    x = table(s, d, "crawl_docs").select(U.site(F.col("url")).alias("site"), U.canonical(F.col("url")).alias("c"), word_count(F.col("markdown")).alias("w")).where("site IS NOT NULL")
    return x.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("c").alias("addresses"), F.round(F.avg("w"), 6).alias("avg_words"), F.min("c").alias("first_url"))
