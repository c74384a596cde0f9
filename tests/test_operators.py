"""DataFrame operators over small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelake.operators import dedup, evaluate, graph, pages, robots
from pagelake.options import CrawlOptions, DigestOptions, ExtractOptions, InvalidOption, MapOptions, ScrapeOptions, check_selector, check_url
from pagelake.plans.crawl import crawl
from pagelake.plans.digest import llmstxt, map_urls
from pagelake.sources import tables

PAGE = "<html lang='en'><head><title>T {n}</title></head><body><article><h1>Title {n}</h1><p>" + "some words of a page " * 12 + "</p><a href='/x'>x</a></article></body></html>"


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = [(k, f"https://a.example/p{k}", 200, "text/html", PAGE.replace("{n}", str(k)) if k != 3 else None) for k in range(5)]
    return spark.createDataFrame(rows, "page_id LONG, url STRING, status_code INT, content_type STRING, html STRING")


def test_scrape(snapshot):
    got = {r.page_id: r for r in pages.scrape(snapshot, ScrapeOptions(formats=("markdown", "links", "rawHtml"))).collect()}
    assert got[0].markdown.startswith("# Title 0") and got[0].links == ["https://a.example/x"] and got[0].raw_html and got[0].html is None and got[0].quality_error is None
    assert got[3].markdown is None and got[3].quality_error == "empty_content" and got[0].metadata.word_count > 40 and got[0].metadata.language == "en"
    assert pages.scrape(snapshot.limit(0)).count() == 0


def test_extract_modes(snapshot):
    o = ExtractOptions(selectors={"t": "h1", "missing": ".no", "gone": ".gone"}, mode="auto")
    by_css = {r.row_id: r for r in pages.extract(snapshot, "page_id", "html", o).collect()}
    assert '"t": "Title 1"' in by_css[1].data and by_css[3].error == "no content"
    by_model = {r.row_id: r for r in pages.extract(snapshot, "page_id", "html", o, lambda text, schema: {"n": len(text)}).collect()}
    assert '"n"' in by_model[1].data

    def broken(text, schema):
        raise ValueError("no")

    assert "ValueError" in pages.extract(snapshot, "page_id", "html", ExtractOptions(mode="llm"), broken).where("row_id = 1").collect()[0].error


def test_engine_choice(snapshot):
    assert {r.engine for r in pages.engine_choice(snapshot).where("page_id <> 3").collect()} == {"http"}


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a\n"), (2, " a"), (3, None), (4, None), (5, ""), (6, " ")], "id LONG, t STRING")
    got = {r.id: (r.first_id, r.is_duplicate) for r in dedup.content_duplicates(df, "id", "t").collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False), 6: (5, True)}
    assert dedup.distinct_contents(df, "t").collect()[0].n == 2
    assert sorted(r.id for r in dedup.keep_first(df, F.trim("t"), "id").collect()) == [1, 2, 3, 4, 5]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", None), ("a", "b")], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("a",)], "url STRING")
    assert {(r.url, r.depth) for r in graph.reachable(e, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.url, r.n_in, r.n_out) for r in graph.degrees(e).collect()} == {("a", 1, 2), ("b", 1, 1), ("c", 2, 2), ("d", 1, 0)}
    chain = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1")], "src STRING, dst STRING")
    assert [(r.url, r.pos) for r in graph.follow_chain(chain, spark.createDataFrame([("p1",)], "url STRING")).orderBy("pos").collect()] == [("p1", 0), ("p2", 1), ("p3", 2)]
    assert graph.reachable(e.limit(0), seeds, 3).count() == 1


def site(spark):
    base = "https://a.example"
    docs = [(base + "/", "root", 200), (base + "/docs/a", "same", 200), (base + "/docs/b", "same", 200), (base + "/x/y/z", "deep", 200), (base + "/bad", "oops", 500), ("https://b.example/", "other", 200)]
    edges = [(base + "/", base + "/docs/a"), (base + "/", base + "/docs/b"), (base + "/", base + "/bad"), (base + "/docs/a", base + "/x/y/z"), (base + "/", "https://b.example/"), (base + "/", base + "/gone"), (base + "/", None)]
    return spark.createDataFrame(docs, "url STRING, markdown STRING, status_code INT"), spark.createDataFrame([(a, b, "link") for a, b in edges], "src STRING, dst STRING, kind STRING")


def simulate(docs, edges, seed, max_depth):
    """Exact priority order: root first, then by priority, depth, address."""
    from pagelake.functions.urls import priority

    del priority
    seen, order, todo = set(), [], [(seed, 0)]
    while todo:
        url, depth = todo.pop(0)
        if url in seen:
            continue
        seen.add(url)
        order.append((url, depth))
        if depth < max_depth and docs.get(url, 500) < 400:
            todo += [(b, depth + 1) for a, b in edges if a == url and b]
    return order


def test_crawl(spark):
    docs, edges = site(spark)
    got = {r.url: r for r in crawl(docs, edges, ["http://www.a.example"], CrawlOptions(max_depth=2, batch=1, allow_backward_links=True)).collect()}
    assert set(got) == {"https://a.example/", "https://a.example/docs/a", "https://a.example/docs/b", "https://a.example/x/y/z", "https://a.example/bad", "https://a.example/gone"}
    assert got["https://a.example/"].crawl_order == 1 and got["https://a.example/bad"].error == "error_page" and got["https://a.example/gone"].error == "not_found"
    assert got["https://a.example/docs/b"].is_duplicate != got["https://a.example/docs/a"].is_duplicate
    assert got["https://a.example/x/y/z"].depth == 2
    reach = {u for u, _ in simulate({r.url: r.status_code for r in docs.collect()}, [(r.src, r.dst) for r in edges.collect()], "https://a.example/", 2)} - {"https://b.example/"}
    assert set(got) == reach
    wide = crawl(docs, edges, ["https://a.example/"], CrawlOptions(max_depth=1, batch=50, allow_external_links=True))
    assert "https://b.example/" in {r.url for r in wide.collect()}
    assert crawl(docs, edges, ["https://a.example/"], CrawlOptions(limit=1, batch=10)).count() == 1


def test_crawl_robots(spark):
    docs, edges = site(spark)
    rb = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /docs/")], "host STRING, content STRING")
    got = {r.url: r.error for r in crawl(docs, edges, ["https://a.example/"], CrawlOptions(max_depth=1, allow_backward_links=True), rb).collect()}
    assert got["https://a.example/docs/a"] == "robots_disallowed" and got["https://a.example/"] is None


def test_map_and_digest(spark):
    _, edges = site(spark)
    assert [r.url for r in map_urls(edges, None, "https://a.example", MapOptions(search="docs", include_subdomains=False)).collect()] == ["https://a.example/docs/a", "https://a.example/docs/b"]
    meta = "STRUCT<status_code: INT, robots: STRING, og_title: STRING, og_description: STRING>"
    docs = spark.createDataFrame(
        [(1, "https://a.example/b", "B", None, "text b", (200, None, None, "od")), (2, "https://a.example/a", None, "d", "text a", (None, None, None, None)), (3, "https://a.example/c", "Not Found", None, "x", (200, None, None, None)), (4, "https://a.example/d", "D", None, "x", (200, "noindex", None, None)), (5, None, "E", None, "x", None)],
        f"page_id LONG, url STRING, title STRING, description STRING, markdown STRING, metadata {meta}",
    )
    r = llmstxt(docs, DigestOptions(max_urls=5)).collect()
    assert len(r) == 1 and r[0].urls_processed == 2 and r[0].urls_total == 4
    assert r[0].llmstxt == "# https://a.example\n\n- [a](https://a.example/a): d\n- [B](https://a.example/b): od\n"
    assert r[0].llms_fulltxt.count("---") == 1


def test_robots_tables(spark):
    df = spark.createDataFrame([("a", "User-agent: x\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: 2 # c\nSitemap: https://a/s.xml\r\n"), ("b", None), ("c", "")], "host STRING, content STRING")
    got = {r.host: r.d for r in df.select("host", robots.crawl_delay_column(F.col("content"), "bot").alias("d")).collect()}
    assert got == {"a": 2.0, "b": None, "c": None}
    assert [tuple(r) for r in robots.sitemap_directives(df, "host", "content").collect()] == [("a", "https://a/s.xml")]
    maps = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc>u1</loc></url></urlset>"), ("t", "http://x\nno")], "u STRING, b STRING")
    entries = robots.sitemap_entries(maps, "u", "b")
    assert [r.url for r in robots.expand_sitemaps(entries, spark.createDataFrame([("r",)], "sitemap STRING")).collect()] == ["u1"]


def test_evaluation(spark):
    rows = [(k, "u", k % 3 != 0, 100 * k, f"h{k % 2}", "http" if k % 2 else "browser", k) for k in range(1, 11)]
    m = spark.createDataFrame(rows, "metric_id LONG, url STRING, success BOOLEAN, response_time_ms LONG, content_hash STRING, engine_tag STRING, markdown_length LONG")
    p = evaluate.percentiles(m, "response_time_ms", {"p50": 0.5, "p90": 0.9}, ["url"]).collect()[0]
    assert (p.p50, p.p90) == (600, 900)
    assert evaluate.content_drift(m).collect()[0].contents == 2
    q = evaluate.engine_parity(m, "http", "browser").collect()[0]
    assert q.ms_delta == -100 and not q.same_content
    f = evaluate.trailing_failures(m, "url", F.col("success"), ["metric_id"]).collect()[0]
    assert f.n == 0
    h = evaluate.cache_hits(m.withColumn("ts", F.timestamp_seconds("response_time_ms")), ["url"], "ts", "metric_id", 101)
    assert h.where("hit").count() == 9


def test_options():
    for bad in (lambda: ScrapeOptions(formats=("pdf",)), lambda: CrawlOptions(limit=0), lambda: MapOptions(limit=10**6), lambda: DigestOptions(max_urls=501), lambda: ExtractOptions(mode="x"), lambda: ScrapeOptions(include_tags=("a[",)), lambda: check_url("ftp://x"), lambda: check_selector("a<script"), lambda: check_url("https://" + "x" * 3000)):
        with pytest.raises(InvalidOption):
            bad()
    check_url("https://a.example/x")


def fake_fetch(url):
    if "bad" in url:
        raise OSError("refused")
    return 200, "text/html", f"<p>{url}</p>"


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "c.txt").write_text("# comment\n\nnews | https://a.example | Front page | 80\ndocs|https://b.example|B|x\n")
    got = tables.read_corpus(spark, str(tmp_path / "c.txt")).collect()
    assert [(r.category, r.min_words) for r in got] == [("news", 80), ("docs", 50)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.xml.gz.bin").write_bytes(gzip.compress(b"<urlset/>"))
    (tmp_path / "m" / "b.xml").write_bytes(b"plain")
    assert sorted(r.body for r in tables.read_gzipped_sitemaps(spark, str(tmp_path / "m")).collect()) == ["<urlset/>", "plain"]
    tables.register(spark)
    live = spark.read.format("pages_live").option("urls", "https://a.example/\nhttps://bad.example/").option("transport", "pagelake.sources.testing:fetch").load()
    rows = {r.url: r for r in live.collect()}
    assert rows["https://a.example/"].status_code == 200 and "refused" in rows["https://bad.example/"].error
    df = spark.createDataFrame([(1, 0.123456, "https://a.example/x", "text")], "id LONG, r DOUBLE, url STRING, markdown STRING")
    tables.write_metrics_csv(df.select("id", "r"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].r == "0.1235"
    tables.write_markdown_files(df, str(tmp_path / "md"))
    assert (tmp_path / "md" / "name=a.example_x").exists()
    tables.write_json(df, str(tmp_path / "json"))
    tables.append_run(df, str(tmp_path / "runs"), "id")
    tables.append_run(df, str(tmp_path / "runs"), "id")  # again: it takes its own place
    tables.append_run(df.withColumn("id", df["id"] + 1), str(tmp_path / "runs"), "id")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    df.select("url").write.parquet(str(tmp_path / "pages"))
    assert tables.read_pages(spark, str(tmp_path / "pages")).collect()[0].status_code == 200


def test_ranks_over_chunks(spark):
    from pagelake.operators.ranks import numbered, with_previous

    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 2003).alias("v"), "id")
    got = numbered(df, ["k"], ["v"]).collect()
    prev = {r.v: r.p for r in with_previous(df, ["k"], ["v"], F.col("v"), "p").collect()}
    for k in (0, 1):
        mine = sorted((r.v, r.n) for r in got if r.k == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
        assert [prev[v] for v, _ in mine] == [None] + [v for v, _ in mine[:-1]]
    assert numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_crawl_options_work(spark):
    from pagelake.options import CrawlOptions
    from pagelake.plans.crawl import crawl

    names = [f"https://a.example/p{k}" for k in range(30)]
    pages = spark.createDataFrame([(u, f"text {u}", 200) for u in ["https://a.example/", *names, *[f"{u}/x" for u in names]]], "url STRING, markdown STRING, status_code INT")
    edges = [("https://a.example/", u, "link") for u in names] + [(u, f"{u}/x", "link") for u in names]
    links = spark.createDataFrame(edges, "src STRING, dst STRING, kind STRING")
    every = crawl(pages, links, ["https://a.example/"], CrawlOptions(limit=None, queue_size=None, max_depth=2))
    assert every.count() == 61
    # a full queue refuses addresses; those that come again by another link are taken then
    small = crawl(pages, links, ["https://a.example/"], CrawlOptions(limit=None, queue_size=5, batch=5, max_depth=2))
    assert 6 <= small.count() <= 61
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /p1", None)], "host STRING, content STRING, crawl_delay DOUBLE")
    strict = crawl(pages, links, ["https://a.example/"], CrawlOptions(limit=None, max_depth=1), robots)
    base = crawl(pages, links, ["https://a.example/"], CrawlOptions(limit=None, max_depth=1, robots_mode="base"), robots)
    assert strict.where("error = 'robots_disallowed'").count() == 11 and base.where("error IS NOT NULL").count() == 0
    shut = crawl(pages, links, ["https://a.example/p1"], CrawlOptions(limit=None, max_depth=1, robots_mode="base"), robots)
    assert shut.count() == 0


def test_chains_follow_every_edge(spark):
    from pagelake.operators.graph import follow_chain

    e = [("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("c", "d"), *[(f"n{k}", f"n{k + 1}") for k in range(20)]]
    edges = spark.createDataFrame(e, "src STRING, dst STRING")
    seeds = spark.createDataFrame([("a",), ("n0",), (None,)], "url STRING")
    got = {(r.seed, r.url): r.pos for r in follow_chain(edges, seeds).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sum(k[0] == "n0" for k in got) == 11
    assert follow_chain(edges, seeds, max_pages=3, max_depth=10).where("seed = 'n0'").count() == 3
    assert follow_chain(edges, seeds, None, 30).where("seed = 'n0'").count() == 21


def test_judge_output(spark):
    from pyspark.sql import functions as F

    from pagelake.functions.scalars import judge_result

    rows = ['[{"type":"a"},{"type":"result","result":"{\\"x\\":1}"},{"type":"result","result":"two"},{"type":"z"}]', '{"result":"one"}', '[{"k":1},{"k":2}]', '{"k":3}', None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "r STRING").select(judge_result(F.col("r"))).collect()]
    assert got == ["two", "one", '{"k":2}', '{"k":3}', None]


def test_request_limits():
    import pytest

    from pagelake.options import InvalidOption, check_actions, check_concurrency

    check_actions(({"type": "click", "selector": "a.next"}, {"type": "wait", "milliseconds": 10}, {"type": "scroll"}))
    check_concurrency(1)
    for bad in (({"type": "fly"},), ({"type": "click", "selector": ""},), ({"type": "wait", "milliseconds": 10**6},), ({"type": "scroll"},) * 51):
        with pytest.raises(InvalidOption):
            check_actions(bad)
    with pytest.raises(InvalidOption):
        check_concurrency(0)
