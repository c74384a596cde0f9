"""Queries of pagination, evaluation targets, writers and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html_text as H
from ..functions import scalars as S
from ..functions import urls as U
from ..operators import evaluate as E
from .data_q import _ADV, _WINNERS, _folder, _winners
from .pages_q import _PLAIN
from .registry import query, sql_canonical, sql_site, sql_words, table, wide_table

_NUMBER = "try_cast(nullif(regexp_extract({u}, '(?:/page/|[?&](?:page|p)=)([0-9]+)', 1), '') AS BIGINT)"


def _number(u: str) -> str:
    return _NUMBER.format(u=u)


@query(
    f"""WITH e AS (SELECT DISTINCT src, dst FROM crawl_edges WHERE dst IS NOT NULL AND kind = 'pagination' AND NOT regexp_matches(src || dst, '["<>& ]')),
    f AS (SELECT src, dst FROM e UNION SELECT src, regexp_replace(src, '(/page/|[?&]page=|[?&]p=)([0-9]+)', '\\1' || CAST({_number('src')} + 1 AS VARCHAR)) FROM e WHERE {_number('src')} IS NOT NULL)
    SELECT src, dst FROM f WHERE src <> dst AND ({_number('src')} IS NULL OR {_number('dst')} IS NULL OR {_number('dst')} > {_number('src')})"""
)
def pagination_candidates(s, d):
    """Pages that show every pagination edge of the crawl as links, by turns a
    rel=next link, a link that says next and a numbered one, read back."""
    from ..operators.pages import pagination_edges

    e = table(s, d, "crawl_edges").where("dst IS NOT NULL AND kind = 'pagination'").select("src", "dst").distinct()
    e = e.where(~F.concat("src", "dst").rlike('["<>& ]'))
    link = F.concat(F.lit('<a class="pager" href="'), F.col("dst"), F.lit('">Next page</a> <a href="'), F.col("dst"), F.lit('">99999999</a>'))
    pages = e.groupBy("src").agg(F.concat(F.lit("<html><body><p>x</p>"), F.array_join(F.sort_array(F.collect_set(link)), " "), F.lit("</body></html>")).alias("html"))
    return pagination_edges(pages, "html", "src")


@query("SELECT CAST(0 AS BIGINT) AS n FROM (SELECT 1)")
def pagination_last_pages(s, d):
    """The same pages with a disabled next button lead nowhere."""
    from ..operators.pages import pagination_edges

    e = table(s, d, "crawl_edges").where("dst IS NOT NULL AND kind = 'pagination'").select("src", "dst").distinct()
    pages = e.groupBy("src").agg(F.concat(F.lit('<p><button class="next" disabled>Next</button></p><a rel="next" href="'), F.min("dst"), F.lit('">Next</a>')).alias("html"))
    return pagination_edges(pages, "html", "src").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT category, round(avg(CASE WHEN speed = 'a' THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) AS n, rank() OVER (ORDER BY round(avg(CASE WHEN speed = 'a' THEN 1.0 ELSE 0.0 END), 6) DESC, category) AS place FROM ({_WINNERS}) GROUP BY category")
def categories_by_win_rate(s, d):
    from pyspark.sql import Window

    r = _winners(s, d).groupBy("category").agg(F.round(F.avg((F.col("speed") == "a").cast("double")), 6).alias("win_rate"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("win_rate"), F.asc_nulls_last("category"))  # one row a category
    return r.withColumn("place", F.rank().over(w).cast("long"))


_DIMS = ("words", "links", "images", "speed")


@query(
    f"""SELECT url, category, round(CAST(adv AS DOUBLE), 6) AS advantage, array_to_string(list_filter([{', '.join(f"CASE WHEN {x} = 'b' THEN '{x}' END" for x in _DIMS)}], lambda v: v IS NOT NULL), ',') AS weak_dimensions,
    CASE WHEN adv < -0.3 THEN 'high' WHEN adv < -0.1 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT *, {_ADV} AS adv FROM ({_WINNERS})) WHERE adv < -0.05"""
)
def improvement_targets(s, d):
    got = E.improvement_targets(_winners(s, d), list(_DIMS), S.advantage({k: F.col(k) for k in _DIMS}))
    return got.withColumn("weak_dimensions", F.array_join("weak_dimensions", ","))


@query(
    "SELECT category, round(avg(CASE WHEN coalesce(success, false) THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) AS n FROM scrape_metrics WHERE CAST(scraped_at AS DATE) = (SELECT max(CAST(scraped_at AS DATE)) FROM scrape_metrics) GROUP BY category"
)
def eval_latest_category(s, d):
    m = table(s, d, "scrape_metrics").withColumn("day", F.to_date("scraped_at"))
    return E.latest_run_rates(m, "day", "category", F.coalesce("success", F.lit(False)))


@query(
    "SELECT count(*) AS results, count(c.url) AS scraped, count(*) - count(c.url) AS failed, round(avg(m.response_time_ms), 6) AS avg_ms FROM (SELECT DISTINCT metric_id, url, response_time_ms FROM scrape_metrics) m LEFT JOIN (SELECT DISTINCT url FROM page_cache WHERE url IS NOT NULL) c ON m.url = c.url"
)
def search_scrape_stats(s, d):
    m = table(s, d, "scrape_metrics").select("metric_id", "url", "response_time_ms").distinct()
    c = table(s, d, "page_cache").where("url IS NOT NULL").select(F.col("url").alias("cached")).distinct()
    j = m.join(c, m["url"] == c["cached"], "left")
    n = F.count(F.lit(1))
    return j.agg(n.alias("results"), F.count("cached").alias("scraped"), (n - F.count("cached")).alias("failed"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms"))


_LAST = "SELECT url, arg_max(word_count, metric_id) AS word_count, arg_max(response_time_ms, metric_id) AS response_time_ms FROM (SELECT DISTINCT metric_id, url, word_count, response_time_ms FROM scrape_metrics WHERE url IS NOT NULL AND word_count IS NOT NULL AND response_time_ms IS NOT NULL) GROUP BY url"


@query(f"SELECT url, CAST(word_count AS BIGINT) AS word_count, CAST(response_time_ms AS BIGINT) AS response_time_ms FROM ({_LAST})")
def eval_baselines(s, d):
    """Baselines written as JSON and read again."""
    from ..sources.tables import load_baselines, save_baselines

    folder = _folder(s)
    m = table(s, d, "scrape_metrics").where("word_count IS NOT NULL AND response_time_ms IS NOT NULL")
    save_baselines(m, folder, ["word_count", "response_time_ms"])
    return load_baselines(s, folder, "url STRING, word_count BIGINT, response_time_ms BIGINT")


@query("SELECT DISTINCT metric_id, category, coalesce(error, 'none') AS error, attempts FROM scrape_metrics WHERE metric_id IS NOT NULL")
def metrics_csv(s, d):
    """Metrics written as CSV with a header and read again."""
    from ..sources.tables import write_metrics_csv

    folder = _folder(s)
    write_metrics_csv(table(s, d, "scrape_metrics").where("metric_id IS NOT NULL").select("metric_id", "category", F.coalesce("error", F.lit("none")).alias("error"), "attempts").distinct(), folder)
    return s.read.option("header", True).schema("metric_id BIGINT, category STRING, error STRING, attempts BIGINT").csv(folder)


@query("SELECT CAST(scraped_at AS DATE) AS run_id, count(*) AS n FROM scrape_metrics WHERE scraped_at IS NOT NULL GROUP BY 1")
def eval_store(s, d):
    """Runs put into the store twice over: the second time takes the place of the first."""
    from ..sources.tables import append_run

    folder = _folder(s)
    m = table(s, d, "scrape_metrics").where("scraped_at IS NOT NULL").select("metric_id", F.to_date("scraped_at").alias("run_id"))
    append_run(m, folder)
    append_run(m, folder)
    return s.read.schema("metric_id BIGINT, run_id DATE").parquet(folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT metric_id, category AS verdict FROM scrape_metrics WHERE category IS NOT NULL")
def judge_reply(s, d):
    """Each row as the output of a judge, by turns an array of events and an
    object, and its verdict taken out again."""
    m = table(s, d, "scrape_metrics").where("category IS NOT NULL").select("metric_id", "category").distinct()
    result = F.to_json(F.struct(F.lit("result").alias("type"), F.col("category").alias("result")))
    events = F.concat(F.lit('[{"type":"system","result":"no"},'), result, F.lit(',{"type":"log","text":"end"}]'))
    reply = F.when(F.col("metric_id") % 2 == 0, events).otherwise(result)
    return m.select("metric_id", S.judge_result(reply).alias("verdict"))


_SITEMAPS = "list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(regexp_replace(regexp_extract(x, '(?i)^\\s*sitemap\\s*:(.*)$', 1), '#.*$|\\r', '', 'g'))), lambda x: x <> '')"
_USUAL = "list_transform(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemap.xml.gz', '/sitemap.txt'], lambda p: 'https://' || host || p)"


@query(f"SELECT host, unnest(CASE WHEN len({_SITEMAPS}) > 0 THEN {_SITEMAPS} ELSE {_USUAL} END) AS sitemap, CAST(generate_subscripts(CASE WHEN len({_SITEMAPS}) > 0 THEN {_SITEMAPS} ELSE {_USUAL} END, 1) - 1 AS BIGINT) AS pos FROM site_robots")
def sitemap_locations(s, d):
    from ..operators.robots import sitemap_locations as op

    return op(table(s, d, "site_robots"), "host", "content").withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT cache_id, coalesce(octet_length(encode({_PLAIN})), 0) < 100 AS thin FROM page_cache")
def page_thin(s, d):
    return wide_table(s, d, "page_cache").select("cache_id", H.is_thin(F.col("html")).alias("thin"))


@query(
    f"""SELECT page_id AS metric_id, url, coalesce(metadata.status_code < 400, false) AS success, metadata.status_code AS status_code, CAST(octet_length(encode(coalesce(markdown, ''))) AS BIGINT) AS markdown_length,
    CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS html_length, octet_length(encode(coalesce(markdown, ''))) / nullif(CAST(octet_length(encode(coalesce(html, ''))) AS DOUBLE), 0) AS extraction_ratio, {sql_words('markdown')} AS word_count,
    sha256(markdown) AS content_hash, coalesce(trim(title) <> '', false) AS has_title, coalesce(trim(description) <> '', false) AS has_description, CAST(coalesce(len(links), 0) AS BIGINT) AS link_count, CAST(coalesce(len(images), 0) AS BIGINT) AS image_count FROM crawl_docs"""
)
def metric_rows(s, d):
    return E.metric_rows(table(s, d, "crawl_docs"))


@query()
def md_residual_clean(s, d):
    """Markdown of the crawl without the HTML that is left in it (golden tests)."""
    from ..operators.residual import clean_residual

    return clean_residual(table(s, d, "crawl_docs"), "page_id", "markdown", "url").withColumnRenamed("row_id", "page_id")


@query("SELECT page_id, CASE WHEN regexp_matches(markdown, '[<&\\[\\\\*]|- |:root|\n\n\n') THEN NULL ELSE markdown END AS markdown FROM crawl_docs WHERE NOT regexp_matches(coalesce(markdown, ''), '[<&\\[\\\\*]|- |:root|\n\n\n')")
def md_residual_plain(s, d):
    """Texts without anything to clean come out as they are."""
    x = md_residual_clean(s, d)
    plain = table(s, d, "crawl_docs").where(~F.coalesce("markdown", F.lit("")).rlike("[<&\\[\\\\*]|- |:root|\n\n\n")).select("page_id")
    return x.join(plain, "page_id", "left_semi").select("page_id", "markdown")


@query(f"SELECT DISTINCT {sql_site('dst')} AS host, regexp_extract({sql_site('dst')}, '([^.]+[.])?[^.]+$') AS registrable FROM crawl_edges WHERE {sql_site('dst')} IS NOT NULL")
def hosts_registrable(s, d):
    """Registrable part of every host that is linked to, by the public list."""
    from ..functions.domains import registrable

    hosts = table(s, d, "crawl_edges").select(U.site(F.col("dst")).alias("host")).where("host IS NOT NULL").distinct()
    return hosts.select("host", registrable(s, F.col("host")).alias("registrable"))


@query(f"SELECT {sql_canonical('url')} AS url, count(*) AS n FROM crawl_docs WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def refetched_pages(s, d):
    c = table(s, d, "crawl_docs").where("url IS NOT NULL").groupBy(U.canonical(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    return c.where("n > 1")
