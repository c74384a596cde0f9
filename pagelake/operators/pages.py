"""Operators from HTML to columns; each crosses to Python once a batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html_text as H
from ..functions import text as T
from ..functions.markdown_clean import cap_size, clean, compress_tables
from ..options import ExtractOptions, InvalidOption, ScrapeOptions
from . import render
from .arrow import map_rows, pick, spread
from .htmltree import parse
from .readability import article as readable

_META = ("title", "description", "language", "keywords", "robots", "og_title", "og_description", "og_url", "og_image", "url", "canonical_url")


_SEEN = {
    "seen_frameworks": "seen_frameworks ARRAY<STRING>", "seen_reason": "seen_reason STRING", "seen_ratio": "seen_ratio DOUBLE", "seen_sparse": "seen_sparse BOOLEAN", "seen_error": "seen_error BOOLEAN",
}


def to_markdown(df: DataFrame, id_col: str, html_col: str, url_col: str, options: ScrapeOptions | None = None) -> DataFrame:
    """(row_id, markdown): rendered, then cleaned.  Null HTML gives null."""
    o = options or ScrapeOptions()
    inc, exc, main = list(o.include_tags), list(o.exclude_tags), o.only_main_content

    def run(b: dict[str, list]) -> dict[str, list]:
        return {"row_id": b["i"], "markdown": [render.to_markdown(h, u or "", main, inc, exc) for h, u in zip(b["h"], b["u"], strict=True)]}

    out = map_rows(spread(pick(df, i=id_col, h=html_col, u=url_col)), run, "row_id BIGINT, markdown STRING")
    return out.withColumn("markdown", cap_size(clean(compress_tables(F.col("markdown")))))


def metadata(df: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """One row a page with the metadata read from its head."""
    schema = "row_id BIGINT, " + ", ".join(f"{n} STRING" for n in _META)

    def run(b: dict[str, list]) -> dict[str, list]:
        found = [render.metadata(h, u) for h, u in zip(b["h"], b["u"], strict=True)]
        return {"row_id": b["i"], **{n: [m[n] for m in found] for n in _META}}

    return map_rows(spread(pick(df, i=id_col, h=html_col, u=url_col)), run, schema)


def scrape(pages: DataFrame, options: ScrapeOptions | None = None, id_col: str = "page_id") -> DataFrame:
    """Pages (url, html, status_code, content_type) to documents: the requested
    formats, the metadata struct and ``quality_error``."""
    o = options or ScrapeOptions()
    inc, exc, main = list(o.include_tags), list(o.exclude_tags), o.only_main_content
    formats = set(o.formats)
    wants_html = bool(formats & {"html", "rawHtml"})
    fields = ["row_id BIGINT", "url STRING", *(["html STRING"] if wants_html else []), *_SEEN.values(), "status_code INT", "content_type STRING", "md STRING", "link_list ARRAY<STRING>", "image_list ARRAY<STRING>"]
    fields += [f"m_{n} STRING" for n in _META]

    def run(b: dict[str, list]) -> dict[str, list]:
        rows = [(parse(h or ""), h, u) for h, u in zip(b["h"], b["u"], strict=True)]
        found = [render.metadata(t, u) for t, _, u in rows]
        out = {
            "row_id": b["i"],
            "url": b["u"],
            **({"html": b["h"]} if wants_html else {}),
            **{n: b[n] for n in _SEEN},
            "status_code": b["s"],
            "content_type": b["c"],
            "link_list": [render.links(t, u or "") if "links" in formats and h else None for t, h, u in rows],
            "image_list": [render.images(t, u or "") if "images" in formats and h else None for t, h, u in rows],
            **{f"m_{n}": [m[n] for m in found] for n in _META},
        }
        return out | {"md": [render.to_markdown(h, u or "", main, inc, exc, t) if "markdown" in formats else None for t, h, u in rows]}

    # pages travel through the same batches, so no join brings their text together again
    # and what the JVM reads of a page is read before, so that its HTML need not come back
    given = pick(pages, i=id_col, h="html", u="url", s="status_code", c="content_type").withColumn("s", F.col("s").cast("int"))
    need = H.needs_scripts(F.col("h"))
    given = given.withColumns({
        "seen_frameworks": need["detected_frameworks"], "seen_reason": need["reason"], "seen_ratio": need["content_script_ratio"],
        "seen_sparse": H.text_density(F.col("h")) < 0.05, "seen_error": H.is_error_page(F.col("h"), F.col("s")),
    })
    d = map_rows(spread(given), run, ", ".join(fields))
    md = cap_size(clean(compress_tables(F.col("md"))))
    d = d.withColumn("markdown", md)
    meta = F.struct(
        *[F.col(f"m_{n}").alias(n) for n in _META[:9]], F.col("url"), F.col("url").alias("source_url"), F.col("status_code").cast("int").alias("status_code"),
        F.col("content_type"), F.col("m_canonical_url").alias("canonical_url"), T.word_count(F.col("markdown")).alias("word_count"),
        T.reading_time(F.col("markdown")).alias("reading_time"), T.excerpt(F.col("markdown")).alias("excerpt"), F.col("seen_frameworks").alias("detected_frameworks"),
        F.col("seen_reason").alias("detection_reason"), F.col("seen_ratio").alias("content_script_ratio"),
    )
    null = F.lit(None).cast("string")
    return d.select(
        F.col("row_id").alias(id_col), F.col("m_title").alias("title"), F.col("m_description").alias("description"), "url", "markdown",
        (H.strip_non_content(F.col("html")) if "html" in formats else null).alias("html"), (F.col("html") if "rawHtml" in formats else null).alias("raw_html"),
        F.col("link_list").alias("links"), F.col("image_list").alias("images"), null.alias("screenshot"), meta.alias("metadata"),
        (H.quality_error_of(F.col("seen_sparse"), F.col("seen_error"), F.col("markdown"), F.col("status_code")) if "markdown" in formats else null).alias("quality_error"),
    )


def html_tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(row_id, table_no, headers, rows) of every table."""

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"row_id": [], "table_no": [], "headers": [], "rows": []}
        for i, h in zip(b["i"], b["h"], strict=True):
            for n, (heads, rows) in enumerate(render.tables(h) if h and "<table" in h.lower() else []):
                out["row_id"].append(i)
                out["table_no"].append(n)
                out["headers"].append(heads)
                out["rows"].append([list(r.items()) for r in rows])
        return out

    return map_rows(spread(pick(df, i=id_col, h=html_col)), run, "row_id BIGINT, table_no INT, headers ARRAY<STRING>, rows ARRAY<MAP<STRING, STRING>>")


def content_quality(df: DataFrame, id_col: str, html_col: str, keep: dict[str, str] | None = None) -> DataFrame:
    """Visible bytes, main bytes and the share of navigation of each page.
    ``keep``: boolean columns that come along, new name -> column."""
    names = list(keep or {})

    def run(b: dict[str, list]) -> dict[str, list]:
        got = [render.content_quality(h) for h in b["h"]]
        out = {"row_id": b["i"], "total_visible": [g[0] for g in got], "main_content": [g[1] for g in got], "nav_ratio": [g[2] for g in got]}
        return out | {n: b[n] for n in names}

    schema = "row_id BIGINT, total_visible BIGINT, main_content BIGINT, nav_ratio DOUBLE" + "".join(f", {n} BOOLEAN" for n in names)
    return map_rows(spread(pick(df, i=id_col, h=html_col, **(keep or {}))), run, schema)


def engine_choice(pages: DataFrame, id_col: str = "page_id", threshold: int = 1000) -> DataFrame:
    """Which engine a page wants: a ladder over status, main content and scripts."""
    need = H.needs_scripts(F.col("html"))["needs_scripts"]
    flagged = pages.select(id_col, "html", H.wants_browser(F.col("html"), F.col("status_code")).alias("blocked"), F.coalesce(need, F.lit(True)).alias("shell"))
    d = content_quality(flagged, id_col, "html", {"blocked": "blocked", "shell": "shell"})
    choice = (
        F.when(F.col("blocked"), "browser")
        .when(F.col("main_content") > threshold, "http")
        .when((F.col("total_visible") > threshold) & (F.col("nav_ratio") < 0.7), "http")
        .when(F.col("shell"), "browser")
        .when(F.col("main_content") > threshold / 5, "http")
        .otherwise("browser")
    )
    return d.select(F.col("row_id").alias(id_col), "main_content", "total_visible", F.round("nav_ratio", 6).alias("nav_ratio"), choice.alias("engine"))


def article(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(row_id, title, text) of the article of each page, found by the scores of
    its paragraphs, without markup; the main part where no paragraph scores."""

    def one(h: str | None) -> tuple[str | None, str | None]:
        if not h:
            return None, None
        root = parse(h)
        title = render.select_first(root, "h1") or render.select_first(root, "title")
        name = " ".join(title.text().split()) if title is not None else None
        found = readable(root)
        blocks = [b for e in found for b in render.Renderer().blocks(e)] if found else render.Renderer().blocks(render.main_content(root, len(h)))
        text = "\n\n".join(b.lstrip("# ") for b in blocks)
        return name or None, text or None

    def run(b: dict[str, list]) -> dict[str, list]:
        got = [one(h) for h in b["h"]]
        return {"row_id": b["i"], "title": [g[0] for g in got], "text": [g[1] for g in got]}

    return map_rows(spread(pick(df, i=id_col, h=html_col)), run, "row_id BIGINT, title STRING, text STRING")


def extract(df: DataFrame, id_col: str, html_col: str, options: ExtractOptions, llm: Callable[[str, dict], dict] | None = None, text_col: str | None = None) -> DataFrame:
    """(row_id, data JSON, completeness, error).  Fields by selector; in mode
    auto a record below the completeness goes to the injected model, in mode llm
    every one does.  A failing record keeps its row, with the error."""
    o = options
    cols = {"i": id_col, "h": html_col} | ({"t": text_col} if text_col else {})

    def one(h: str | None, t: str | None) -> tuple[str | None, float, str | None]:
        try:
            if h is None:
                return None, 0.0, "no content"
            data = render.extract(h, o.selectors, o.schema) if o.mode != "llm" else {}
            share = render.completeness(data)
            if o.mode == "llm" or o.mode == "auto" and share < o.completeness and llm is not None:
                if llm is None:
                    raise InvalidOption("mode llm needs a model")
                data = llm(t if t is not None else render.to_markdown(h) or "", o.schema)
                share = render.completeness(data)
            return json.dumps(data, ensure_ascii=False, sort_keys=True), share, None
        except Exception as e:  # a record's own fault stays its own
            return None, 0.0, f"{type(e).__name__}: {e}"

    def run(b: dict[str, list]) -> dict[str, list]:
        got = [one(h, t) for h, t in zip(b["h"], b.get("t", [None] * len(b["h"])), strict=True)]
        return {"row_id": b["i"], "data": [g[0] for g in got], "completeness": [g[1] for g in got], "error": [g[2] for g in got]}

    return map_rows(spread(pick(df, **cols)), run, "row_id BIGINT, data STRING, completeness DOUBLE, error STRING")


def search_results(df: DataFrame, html_col: str, limit: int = 10) -> DataFrame:
    """(pos, title, url, snippet) of result pages, at most ``limit`` a page."""

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"pos": [], "title": [], "url": [], "snippet": []}
        for h in b["h"]:
            for n, (t, u, s) in enumerate(render.search_results(h)[:limit]):
                for k, v in zip(out, (n, t, u, s), strict=True):
                    out[k].append(v)
        return out

    return map_rows(pick(df, h=html_col), run, "pos INT, title STRING, url STRING, snippet STRING")


def pagination_edges(df: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(src, dst) edges to next pages."""

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"src": [], "dst": []}
        for h, u in zip(b["h"], b["u"], strict=True):
            for v in render.pagination_links(h, u) if h and u else []:
                out["src"].append(u)
                out["dst"].append(v)
        return out

    return map_rows(spread(pick(df, h=html_col, u=url_col)), run, "src STRING, dst STRING")
