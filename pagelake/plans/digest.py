"""URL discovery and text digests of sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.domains import public_suffixes, registrable_of
from ..functions.text import trim_all
from ..options import DigestOptions, MapOptions


def map_urls(links: DataFrame, sitemap_urls: DataFrame | None, site_url: str, options: MapOptions | None = None) -> DataFrame:
    """Addresses of a site from its links (src, dst) and its sitemaps, distinct,
    filtered, in order, at most ``limit``."""
    o = options or MapOptions()
    target = F.lit(site_url)
    found = links.where(U.site(F.col("src")) == U.site(target)).select(F.col("dst").alias("url"))
    if sitemap_urls is not None and not o.ignore_sitemap:
        found = found.unionByName(sitemap_urls.select("url"))
    h = U.site(F.col("url"))
    keep = h == U.site(target)
    if o.include_subdomains:
        host = links.sparkSession.range(1).select(U.site(target).alias("h")).collect()[0].h  # one value
        base = registrable_of(host, public_suffixes(links.sparkSession)) or ""
        keep = keep | h.endswith(f".{base}") | (h == base)
    found = found.where("url IS NOT NULL").where(F.coalesce(keep, F.lit(False))).distinct()
    if o.search:
        found = found.where(F.lower("url").contains(o.search.lower()))
    return found.orderBy("url").limit(o.limit)


def digest_title(title: Column, og_title: Column, url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(trim_all(title), F.lit("")), F.nullif(trim_all(og_title), F.lit("")), F.nullif(last, F.lit("")), F.lit("Untitled"))


def digest_description(*candidates: Column) -> Column:
    filled = [F.nullif(trim_all(c), F.lit("")) for c in candidates]
    return F.substring(F.coalesce(*filled, F.lit("No description available")), 1, 150)


def worth_digest(markdown: Column, status: Column, title: Column, robots: Column) -> Column:
    """Pages with text, a good status, a title that speaks of no error, and no
    wish to stay out."""
    low = F.lower(F.coalesce(title, F.lit("")))
    bad = low.contains("not found") | low.contains("404") | F.lower(F.coalesce(robots, F.lit(""))).startswith("noindex")
    return F.coalesce(trim_all(markdown) != "", F.lit(False)) & F.coalesce(status < 400, F.lit(True)) & ~bad


def llmstxt(documents: DataFrame, options: DigestOptions | None = None, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(site, llmstxt, llms_fulltxt, urls_processed, urls_total) by site, from
    documents (url, title, description, markdown, metadata).  A site's own pages
    come first (those of its plain host before those of ``www.``), then by
    address; at most ``max_urls`` of each.  The rank is found in two steps, within
    64 parts of a site and then over the first rows of each, before texts are
    gathered, so that no window sorts a large site."""
    o = options or DigestOptions()
    d = documents.withColumn("site", U.site(F.col("url"))).where("site IS NOT NULL")
    total = d.groupBy("site").agg(F.count(F.lit(1)).alias("urls_total"))
    good = d.where(worth_digest(F.col("markdown"), F.col("metadata.status_code"), F.col("title"), F.col("metadata.robots")))
    # two-step rank: best rows by site and address part first, so no window sorts a whole large site
    part = F.pmod(F.xxhash64("url"), F.lit(64))
    other = F.when(U.host(F.col("url")) == F.col("site"), 0).otherwise(1)
    if o.max_urls is not None:
        local = Window.partitionBy("site", part).orderBy(other, "url", "page_id")
        good = good.withColumn("r", F.row_number().over(local)).where(F.col("r") <= o.max_urls).drop("r")
    top = Window.partitionBy("site").orderBy(other, "url", "page_id")
    good = good.withColumn("ord", F.row_number().over(top))
    if o.max_urls is not None:
        good = good.where(F.col("ord") <= o.max_urls)
    if describe is not None:
        good = describe(good)
    good = good.withColumn("d_title", digest_title(F.col("title"), F.col("metadata.og_title"), F.col("url")))
    good = good.withColumn("d_text", digest_description(F.col("description"), F.col("metadata.og_description")))
    line = F.concat(F.lit("- ["), F.col("d_title"), F.lit("]("), F.col("url"), F.lit("): "), F.col("d_text"), F.lit("\n"))
    section = F.concat(F.lit("## "), F.col("d_title"), F.lit("\nURL: "), F.col("url"), F.lit("\n\n"), F.col("markdown"), F.lit("\n\n"))
    rows = good.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line"), section.alias("section")))).alias("rows"), F.count(F.lit(1)).alias("urls_processed"))
    head = F.concat(F.lit("# https://"), F.col("site"), F.lit("\n\n"))
    full = F.concat(head, F.array_join(F.transform("rows", lambda x: x["section"]), "---\n\n")) if o.show_full_text else F.lit(None).cast("string")
    out = rows.select("site", F.concat(head, F.array_join(F.transform("rows", lambda x: x["line"]), "")).alias("llmstxt"), full.alias("llms_fulltxt"), "urls_processed")
    return out.join(total, "site").select("site", "llmstxt", "llms_fulltxt", "urls_processed", "urls_total")
