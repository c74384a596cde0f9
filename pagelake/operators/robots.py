"""robots.txt and sitemaps as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines


def robots_lines(df: DataFrame, host_col: str, content_col: str) -> DataFrame:
    """(host, pos, name, value) of every directive; comments off, names in lower case."""
    ls = df.select(F.col(host_col).alias("host"), F.posexplode(lines(F.col(content_col))).alias("pos", "line"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"\r", ""))
    name = F.lower(F.trim(F.regexp_extract(bare, "^([^:]+):", 1)))
    value = F.trim(F.regexp_extract(bare, "^[^:]+:(.*)$", 1))
    return ls.select("host", "pos", name.alias("name"), value.alias("value")).where("name <> ''")


def sitemap_directives(df: DataFrame, host_col: str, content_col: str) -> DataFrame:
    return robots_lines(df, host_col, content_col).where("name = 'sitemap' AND value <> ''").select("host", F.col("value").alias("sitemap"))


# Where sitemaps usually lie (fixed values, in order).
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz", "/sitemap.txt")


def sitemap_locations(df: DataFrame, host_col: str, content_col: str) -> DataFrame:
    """(host, pos, sitemap) of where to look for a site's sitemaps, in order: those
    that its robots file names, else the usual places."""
    named = F.filter(F.transform(lines(F.coalesce(F.col(content_col), F.lit(""))), lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"(?i)^\s*sitemap\s*:(.*)$", 1), r"#.*$|\r", ""))), lambda x: x != "")
    usual = F.array(*[F.concat(F.lit("https://"), F.col(host_col), F.lit(p)) for p in WELL_KNOWN])
    return df.select(F.col(host_col).alias("host"), F.posexplode(F.when(F.size(named) > 0, named).otherwise(usual)).alias("pos", "sitemap"))


def crawl_delay_column(content: Column, agent: str = "*") -> Column:
    """The last delay of a group for every agent or for ``agent``; null for none."""
    zero = F.struct(F.lit(False).alias("on"), F.lit(None).cast("double").alias("d"))
    want = agent.lower()

    def step(a: Column, line: Column) -> Column:
        s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "#.*$", ""), r"\r", "")))
        who = F.trim(F.regexp_extract(s, "^user-agent:(.*)$", 1))
        is_agent = s.startswith("user-agent:")
        on = F.when(is_agent, (who == "*") | ((who != "") & F.lit(want).contains(who))).otherwise(a["on"])
        value = F.regexp_extract(s, r"^crawl-delay:\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast("double")
        return F.struct(on.alias("on"), F.when(on & ~is_agent & value.isNotNull(), value).otherwise(a["d"]).alias("d"))

    return F.aggregate(lines(content), zero, step, lambda a: a["d"])


def rules(content: str | None, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, pattern) rules of the group for an agent, else of the group for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    in_rules = False
    for line in (content or "").split("\n"):
        s = line.split("#", 1)[0].strip()
        name, _, value = s.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            in_rules = True
            if value:
                for a in agents:
                    groups[a].append((name == "allow", value))
    want = agent.lower()
    named = next((g for g in sorted(groups, key=len, reverse=True) if g != "*" and g and g in want), None)
    return groups.get(named if named is not None else "*", [])


def is_allowed(content: str | None, path: str, agent: str = "*") -> bool:
    """The longest matching rule decides, allow before disallow; no rule allows."""
    return allowed_by(rules(content, agent), path)


def allowed_by(found: list[tuple[bool, str]], path: str) -> bool:
    best, allowed = -1, True
    for ok, pattern in found:
        rx = "^" + re.escape(pattern).replace(r"\*", ".*")
        rx = rx[:-2] + "$" if rx.endswith(r"\$") else rx
        if re.match(rx, path or "/") and (len(pattern) > best or len(pattern) == best and ok):
            best, allowed = len(pattern), ok
    return allowed


def robots_gate(pages: DataFrame, robots: DataFrame, url_col: str = "url", agent: str = "*") -> DataFrame:
    """``pages`` with ``robots_allowed``; hosts without a file allow all.  The
    files are joined on the host, so nothing is broadcast that grows unchecked."""
    from ..functions.urls import host, path, query
    from .arrow import map_rows

    u = F.col(url_col)
    full = F.concat(F.when(path(u) == "", "/").otherwise(path(u)), F.when(query(u).isNull(), "").otherwise(F.concat(F.lit("?"), query(u))))
    keys = pages.select(u.alias("u"), host(u).alias("h"), full.alias("p")).where("h IS NOT NULL").distinct()
    files = robots.select(F.lower("host").alias("h"), F.col("content").alias("c")).where("c IS NOT NULL").dropDuplicates(["h"])
    joined = keys.join(files, "h")

    def run(b: dict[str, list]) -> dict[str, list]:
        known: dict[str, list] = {}  # each file is read once a batch
        for c in b["c"]:
            if c not in known:
                known[c] = rules(c, agent)
        return {"__u": b["u"], "robots_allowed": [allowed_by(known[c], p) for c, p in zip(b["c"], b["p"], strict=True)]}

    verdict = map_rows(joined.select("u", "p", "c"), run, "__u STRING, robots_allowed BOOLEAN")
    return pages.join(verdict, u == verdict["__u"], "left").drop("__u").withColumn("robots_allowed", F.coalesce("robots_allowed", F.lit(True)))


def sitemap_entries(df: DataFrame, url_col: str, body_col: str) -> DataFrame:
    """(sitemap, kind, loc): child sitemaps of an index, pages of a set, or the
    addresses of a plain list."""
    b = F.col(body_col)
    index = F.regexp_extract_all(b, F.lit(r"(?s)<sitemap[^>]*>.*?<loc>([^<]+)</loc>.*?</sitemap>"), F.lit(1))
    pages = F.regexp_extract_all(b, F.lit(r"(?s)<url[^>]*>.*?<loc>([^<]+)</loc>.*?</url>"), F.lit(1))
    plain = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("http"))
    is_index, is_xml = b.contains("<sitemapindex"), b.contains("<urlset") | b.contains("<sitemapindex")
    entries = F.when(is_index, index).when(is_xml, pages).otherwise(plain)
    kind = F.when(is_index, "sitemap").otherwise("page")
    out = df.select(F.col(url_col).alias("sitemap"), kind.alias("kind"), F.explode(entries).alias("loc"))
    return out.select("sitemap", "kind", F.trim("loc").alias("loc")).distinct()


def expand_sitemaps(entries: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """Pages reachable from root sitemaps, an index at most ``max_depth`` deep;
    cycles end because a sitemap is opened once.  Rounds of joins; each round's
    frontier is small beside the entries."""
    from .arrow import save_point

    seen = roots.select(F.col("sitemap")).distinct()
    frontier = seen
    for _ in range(max_depth):
        nxt = entries.where("kind = 'sitemap'").join(frontier, "sitemap").select(F.col("loc").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti")
        nxt = save_point(nxt)
        if nxt.isEmpty():
            break
        seen, frontier = save_point(seen.unionByName(nxt)), nxt
    return entries.where("kind = 'page'").join(seen, "sitemap", "left_semi").select(F.col("loc").alias("url")).distinct()
