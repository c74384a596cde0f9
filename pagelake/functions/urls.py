"""URL functions as Catalyst expressions (no Python at run time).

URLs are split with regular expressions, so that null, empty and malformed
values give null parts instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
HOST = _HEAD + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
PORT = _HEAD + r"(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]+):([0-9]+)"
USER = _HEAD + r"([^/?#@]*@)"
PATH = _HEAD + r"[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def _part(url: Column, pattern: str) -> Column:
    got = F.regexp_extract(url, pattern, 1)
    return F.when(got != "", got)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://"))


def host(url: Column) -> Column:
    """Host in lower case, without user and port; null for none."""
    return F.lower(_part(url, HOST))


def port(url: Column) -> Column:
    return _part(url, PORT).cast("int")


def path(url: Column) -> Column:
    """Path as spelled; '' for none, null where there is no host."""
    return F.when(host(url).isNotNull(), F.regexp_extract(url, PATH, 1))


def query(url: Column) -> Column:
    return _part(url, QUERY)


def is_http(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def is_valid(url: Column) -> Column:
    """Not empty, at most 2048 bytes, with a scheme and a host."""
    return F.coalesce((F.octet_length(url) <= 2048) & host(url).isNotNull(), F.lit(False))


def without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def site(url: Column) -> Column:
    """Host without one leading ``www.``."""
    return without_www(host(url))


def sorted_query(q: Column) -> Column:
    """Query parameters by key, equal keys in their old order."""
    pairs = F.transform(F.split(q, "&"), lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["x"]), "&")


def canonical(url: Column) -> Column:
    """https, no leading ``www.``, default ports, trailing slashes, index files
    and fragment off, query sorted by key.  Unparsable values stay.  Idempotent.
    One pattern a part and no part twice, as expressions aren't shared."""
    name = F.lower(F.regexp_extract(url, _HEAD + r"(?:[^/?#@]*@)?(?:[wW]{3}\.)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    user = F.regexp_extract(url, USER, 1)
    at_port = F.regexp_replace(F.concat(F.lit(":"), F.regexp_extract(url, PORT, 1)), r"^:(?:0*(?:80|443))?$|(?<=^:)0+(?=[0-9])", "")
    p = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PATH, 1), r"/+$", ""), r"/index\.(?:html|php)$", "")
    p = F.regexp_replace(p, "^$", "/")
    q = F.regexp_extract(url, QUERY, 1)
    q = F.when(F.instr(url, "?") == 0, "").otherwise(F.regexp_replace(F.concat(F.lit("?"), F.when(F.instr(url, "&") == 0, q).otherwise(sorted_query(q))), r"^\?$", ""))
    ok = url.rlike(r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]+)")
    return F.when(ok, F.concat(F.lit("https://"), user, name, at_port, p, q)).otherwise(url)


def canonical_light(url: Column) -> Column:
    """Scheme and ``www.`` stay; fragment and one trailing slash go; host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, _HEAD + r"[^/?#]*", 0))
    low = F.concat(head, F.substring(bare, F.length(head) + 1, F.length(bare)))
    return F.when(host(url).isNull(), url).otherwise(F.regexp_replace(low, "/$", ""))


def permutations(url: Column) -> Column:
    """All spellings of a page's address: two schemes, with and without
    ``www.``, with and without slash, three index files, distinct."""
    base = F.regexp_replace(F.regexp_replace(path(url), r"/+$", ""), r"/index\.(html|php)$", "")
    ends = F.array(F.lit(""), F.lit("/"), F.lit("/index.html"), F.lit("/index.html/"), F.lit("/index.php"), F.lit("/index.php/"))
    heads = F.array(*[F.lit(s + w) for s in ("http://", "https://") for w in ("", "www.")])
    every = F.flatten(F.transform(heads, lambda h: F.transform(ends, lambda e: F.concat(h, site(url), base, e))))
    return F.when(host(url).isNotNull(), F.array_distinct(every))


def resolve(base: Column, relative: Column) -> Column:
    """A link against its page: absolute, ``//host``, ``/path``, ``?query``,
    ``#fragment`` and plain relative forms (dot segments stay)."""
    origin = F.regexp_extract(base, _HEAD + r"[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*/(?:[^/]*/)*)[^/]*$", "$1")
    folder = F.when(folder.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    r = F.trim(relative)
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r))
        .when(r.startswith("/"), F.concat(origin, r))
        .when(r.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), r))
        .when(r.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), r))
        .otherwise(F.concat(folder, r))
    )


# Patterns of addresses worth more or less to a crawl (fixed values; whole URL, case-sensitive).
HIGH_PRIORITY = (
    r"/(index|main|home|about|contact)(\.|$|/)",
    r"/(docs?|documentation|guide|tutorial|api|reference)(/|$)",
    r"/(product|service|feature|pricing|solution)s?(/|$)",
    r"/(blog|article|post|news)/[^/]+/?$",
    r"/(category|tag|topic)/[^/]+/?$",
)
LOW_PRIORITY = (
    r"/page/([2-9]|\d{2,})(/|$)",
    r"[?&]page=([2-9]|\d{2,})(&|$)",
    r"/\d{4}/\d{2}",
    r"\.(pdf|zip|tar|gz|rar|exe|dmg|pkg)$",
    r"\.(jpg|jpeg|png|gif|svg|mp4|mp3|avi|mov|wav)$",
    r"#",
    r"\?[^?]{50,}$",
    r"/(login|logout|admin|account|dashboard|settings|profile)(/|$)",
    r"/(comment|reply|respond)",
    r"[?&](search|q|query)=",
)


def _any(url: Column, patterns: tuple[str, ...]) -> Column:
    return url.rlike("|".join(f"(?:{p})" for p in patterns))


def priority(
    url: Column,
    depth: Column | int = 0,
    high: tuple[str, ...] = HIGH_PRIORITY,
    low: tuple[str, ...] = LOW_PRIORITY,
    base: int = 100,
    per_level: int = 10,
) -> Column:
    """Crawl priority: base, root and top-level bonus, depth, one bonus for a
    high and one malus for a low pattern, one point for each ten bytes over 100."""
    p = path(url)
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    top = F.when(p.isin("", "/"), 100).when((slashes == 1) | ((slashes == 2) & p.endswith("/")), 40).otherwise(0)
    size = F.octet_length(url) + F.when(p == "", 1).otherwise(0)
    long_ = F.when(p.isNotNull() & (size > 100), F.floor((size - 100) / 10)).otherwise(0)
    level = depth if isinstance(depth, Column) else F.lit(depth)
    score = F.lit(base) + F.coalesce(top, F.lit(0)) - level * per_level
    if high:
        score = score + F.when(_any(url, high), 50).otherwise(0)
    if low:
        score = score - F.when(_any(url, low), 50).otherwise(0)
    return F.when(url.isNotNull(), (score - F.coalesce(long_, F.lit(0))).cast("int"))


def priority_bench(url: Column, depth: Column | int, from_sitemap: Column) -> Column:
    """The other score: 1000 less 100 a level, and fixed amounts for the source
    and parts of the address (fixed values)."""
    level = depth if isinstance(depth, Column) else F.lit(depth)

    def add(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        F.lit(1000) - level * 100 + add(from_sitemap, 500) + add(url.contains("/docs/"), 200) + add(url.contains("/api/"), 150)
        + add(url.contains("/blog/"), 100) - add(url.contains("?"), 50) - add(url.contains("#"), 25)
    ).cast("long")


def page_number(url: Column) -> Column:
    """Number of a paginated address: /page/N, page=N or p=N, in that order."""
    found = [F.regexp_extract(url, p, 1) for p in (r"/page/(\d+)", r"[?&]page=(\d+)", r"[?&]p=(\d+)")]
    as_number = [F.when(F.length(x).between(1, 18), x).try_cast("long") for x in found]
    return F.coalesce(*[F.when(n <= 4294967295, n) for n in as_number])


def next_page(url: Column) -> Column:
    """Address of the next page by the numbering of this one; null for none."""
    n = page_number(url)

    def swap(prefix: str) -> Column:
        old = F.concat(F.lit(prefix), n.cast("string"))
        return F.when(url.contains(old), F.replace(url, old, F.concat(F.lit(prefix), (n + 1).cast("string"))))

    return F.when(n.isNotNull(), F.coalesce(swap("/page/"), swap("page="), swap("p=")))


def rewrite_documents(url: Column) -> Column:
    """Office documents on the web to an address that gives their content:
    slides, texts, tables, files, the first that fits (fixed values)."""
    h, p = host(url), path(url)
    docs, drive = h.contains("docs.google.com"), h.contains("drive.google.com")

    def ident(after: str) -> Column:
        return F.regexp_extract(p, after + "([^/]+)", 1)

    sheet, item = ident("/spreadsheets/d/"), ident("/file/d/")
    return F.coalesce(
        F.when(docs & p.contains("/presentation/") & p.contains("/edit"), F.replace(url, F.lit("/edit"), F.lit("/export/pdf"))),
        F.when(docs & p.contains("/document/") & p.contains("/edit"), F.replace(url, F.lit("/edit"), F.lit("/export?format=pdf"))),
        F.when(
            docs & p.contains("/spreadsheets/") & p.contains("/edit") & (sheet != ""),
            F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sheet, F.lit("/gviz/tq?tqx=out:html")),
        ),
        F.when(drive & p.contains("/view") & (item != ""), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), item)),
        url,
    )


def glob_to_regex(glob: str) -> str:
    """``*`` within a path segment, ``**`` across segments, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            c = glob[i]
            out, i = out + ("\\" + c if c in r".+()|[]{}^$\\" else c), i + 1
    return f"^(?:{out})$"


def matches_globs(url: Column, globs: list[str]) -> Column:
    """Whether the path or the whole address matches any glob."""
    if not globs:
        return F.lit(False)
    pattern = "|".join(glob_to_regex(g) for g in globs)
    return F.coalesce(path(url).rlike(pattern) | url.rlike(pattern), F.lit(False))


def admitted(url: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Include and exclude globs: exclusion wins, no include list admits all."""
    keep = matches_globs(url, include) if include else F.lit(True)
    return keep & ~matches_globs(url, exclude or [])


def is_forward(link: Column, page: Column) -> Column:
    """Same path as the page's or below it, on the border of a segment."""
    p, base = path(link), path(page)
    stem = F.regexp_replace(base, "/$", "")
    return F.coalesce((p == base) | p.startswith(F.concat(stem, F.lit("/"))), F.lit(False))


def admit_link(link: Column, page: Column, external: bool = False, backward: bool = False) -> Column:
    """Link admission of a crawl, relative to the page that holds the link."""
    if external:
        return F.lit(True)
    same = F.coalesce(site(link) == site(page), F.lit(False))
    return same if backward else same & is_forward(link, page)


def is_circular(target: Column, current: Column) -> Column:
    return F.coalesce(page_number(target) <= page_number(current), F.lit(False))


# Names that never leave a private network (fixed values).
PRIVATE_NAMES = ("localhost", "metadata.google.internal", "169.254.169.254", "metadata", "instance-data", "consul", "vault")
PRIVATE_NETS = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|255\.255\.255\.255$|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)"


_GROUP = "[0-9a-f]{1,4}"


def ipv6_groups(h: Column) -> Column:
    """The eight groups of an IPv6 literal (in brackets or bare, ``::`` filled in,
    a dotted tail as two groups) as numbers; null for anything else."""
    a = F.lower(F.regexp_replace(h, r"^\[|\]$|%.*$", ""))
    tail = F.regexp_extract(a, r":(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", 0)
    parts = [F.regexp_extract(a, r":(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in (1, 2, 3, 4)]
    hexed = F.concat(F.lit(":"), F.lower(F.hex(parts[0] * 256 + parts[1])), F.lit(":"), F.lower(F.hex(parts[2] * 256 + parts[3])))
    a = F.when(tail != "", F.concat(F.regexp_replace(a, r":[0-9.]+$", ""), hexed)).otherwise(a)
    n = F.size(F.filter(F.split(a, ":"), lambda x: x != ""))
    zeros = F.array_join(F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), ":")
    full = F.when(a.contains("::"), F.concat_ws(":", F.nullif(F.regexp_extract(a, "^(.*?)::", 1), F.lit("")), F.nullif(zeros, F.lit("")), F.nullif(F.regexp_extract(a, "::(.*)$", 1), F.lit("")))).otherwise(a)
    return F.when(full.rlike(rf"^{_GROUP}(:{_GROUP}){{7}}$"), F.transform(F.split(full, ":"), lambda x: F.conv(x, 16, 10).cast("int")))


def is_private_ipv6(h: Column) -> Column:
    """Loopback, unspecified, unique local (fc00::/7), link local (fe80::/10) and
    mapped private IPv4 addresses."""
    g = ipv6_groups(h)
    first, lead = F.get(g, 0), F.forall(F.slice(g, 1, 7), lambda x: x == 0)
    here = lead & F.get(g, 7).isin(0, 1)
    v4 = F.concat_ws(".", *[F.floor(F.get(g, k) / 256).cast("string") if hi else (F.get(g, k) % 256).cast("string") for k in (6, 7) for hi in (True, False)])
    mapped = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (F.get(g, 5) == 65535) & v4.rlike(PRIVATE_NETS)
    return F.coalesce(here | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF) | mapped, F.lit(False))


def is_private_target(url: Column) -> Column:
    """Literal private addresses and internal names, or no web address at all."""
    h = host(url)
    names = "|".join(n.replace(".", r"\.") for n in PRIVATE_NAMES)
    internal = h.rlike(rf"(^|\.)({names})$") | h.rlike(PRIVATE_NETS) | is_private_ipv6(h)
    return F.coalesce(internal, F.lit(False)) | ~is_http(url)


# Advertising and analytics hosts whose requests are dropped (fixed values).
TRACKERS = (
    "googletagmanager.com",
    "google-analytics.com",
    "analytics.google.com",
    "facebook.net",
    "connect.facebook.net",
    "doubleclick.net",
    "googlesyndication.com",
    "adservice.google.com",
    "static.ads-twitter.com",
    "ads-twitter.com",
    "ads.linkedin.com",
    "bat.bing.com",
    "stats.wp.com",
    "scorecardresearch.com",
    "quantserve.com",
    "chartbeat.com",
    "hotjar.com",
    "mouseflow.com",
    "mixpanel.com",
    "segment.io",
    "segment.com",
    "analytics.tiktok.com",
    "mktoresp.com",
    "pardot.com",
)


def is_tracker(url: Column) -> Column:
    """Whether the address holds the name of a blocked host."""
    return F.coalesce(url.rlike("|".join(t.replace(".", "\\.") for t in TRACKERS)), F.lit(False))


def file_name(url: Column) -> Column:
    """A name for a file that holds the page."""
    return F.translate(F.regexp_replace(url, "^https?://", ""), "/?&=", "____")


def cache_key(url: Column, headers: Column) -> Column:
    """SHA-256 over the address and the header pairs in their order."""
    flat = F.transform(headers, lambda h: F.concat(h["k"], F.lit("\u0001"), h["v"]))
    return F.sha2(F.concat(url, F.coalesce(F.array_join(flat, "\u0002"), F.lit(""))), 256)


def percent_encode(text: Column) -> Column:
    """Percent-encoded for a query, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def percent_decode(text: Column) -> Column:
    """Percent-decoded, a plus stays one; null where the encoding is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def search_target(url: Column) -> Column:
    """The address behind a search engine's redirect (parameter ``uddg``)."""
    wrapped = F.regexp_extract(url, r"[?&]uddg=([^&]*)", 1)
    return F.when(wrapped != "", percent_decode(wrapped)).otherwise(url)
