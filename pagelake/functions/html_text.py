"""What can be read from HTML by pattern, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import decode_entities
from .text import trim_all


def _filled(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def title(html: Column) -> Column:
    return _filled(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def language(html: Column) -> Column:
    """The language attribute as spelled; null for none."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([^\"'>\s]*)", 1), F.lit(""))


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of the first such meta element, whichever attribute stands first."""
    n = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"(?is)<meta[^>]*\s{attribute}=[\"']{n}[\"'][^>]*\scontent=\"([^\"]*)\"", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]*\scontent=\"([^\"]*)\"[^>]*\s{attribute}=[\"']{n}[\"']", 1)
    return F.coalesce(_filled(decode_entities(a)), _filled(decode_entities(b)))


def canonical_link(html: Column) -> Column:
    a = F.regexp_extract(html, r"(?is)<link[^>]*\srel=[\"']canonical[\"'][^>]*\shref=\"([^\"]*)\"", 1)
    b = F.regexp_extract(html, r"(?is)<link[^>]*\shref=\"([^\"]*)\"[^>]*\srel=[\"']canonical[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def first_heading(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return _filled(decode_entities(F.regexp_replace(inner, "<[^>]*>", "")))


def hrefs(html: Column) -> Column:
    """Link targets in the order of the document, repeats kept."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)), decode_entities)


def image_sources(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<img\s[^>]*?src="([^"]*)"'), F.lit(1)), lambda u: ~u.startswith("data:") & (u != ""))


def crawl_links(html: Column) -> Column:
    """Targets worth a visit: no scripts, mail, phone or fragments; distinct, sorted."""
    keep = F.filter(hrefs(html), lambda u: ~F.lower(u).rlike(r"^(javascript:|mailto:|tel:|#)") & (u != ""))
    return F.array_sort(F.array_distinct(F.transform(keep, lambda u: F.regexp_replace(u, "#.*$", ""))))


def strip_non_content(html: Column) -> Column:
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<noscript\b.*?</noscript>", r"(?is)<svg\b.*?</svg>", r"(?is)<head\b.*?</head>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, p, "")
    return html


def plain_text(html: Column) -> Column:
    """Visible text: non-content elements and tags off, references decoded, space collapsed."""
    t = F.regexp_replace(strip_non_content(html), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(t), r"[ \t\r\n\f]+", " "))


def text_density(html: Column) -> Column:
    """Bytes of visible text by bytes of HTML; 0 for no HTML."""
    return F.coalesce(F.try_divide(F.octet_length(plain_text(html)).cast("double"), F.octet_length(html)), F.lit(0.0))


def script_ratio(html: Column) -> Column:
    """Text against text plus scripts (a source counts ten times its length)."""
    inline = F.aggregate(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), F.lit(0), lambda a, x: a + F.octet_length(x))
    src = F.aggregate(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*\ssrc="([^"]*)"'), F.lit(1)), F.lit(0), lambda a, x: a + 10 * F.octet_length(x))
    text = F.octet_length(plain_text(html))
    weight = inline + src
    return F.when(weight == 0, F.lit(1.0)).otherwise(text / (text + weight).cast("double"))


def table_bytes(html: Column) -> Column:
    tables = F.regexp_extract_all(html, F.lit(r"(?is)(<table[^>]*>.*?</table>)"), F.lit(1))
    return F.aggregate(F.transform(tables, F.octet_length), F.lit(0), lambda a, x: a + x).cast("long")


def charset(content_type: Column, html: Column) -> Column:
    """Header, then a meta element in the first 2048 characters, then UTF-8."""
    head = F.substring(html, 1, 2048)
    a = F.regexp_extract(F.lower(content_type), r"charset=[\"']?([a-z0-9_\-]+)", 1)
    b = F.regexp_extract(F.lower(head), r"<meta[^>]*charset=[\"']?([a-z0-9_\-]+)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("utf-8"))


def video_posters(html: Column) -> Column:
    return F.regexp_replace(html, r'(?is)(<video[^>]*\sposter="([^"]*)"[^>]*>)', '$1<img src="$2" alt="Video poster">')


# ---- does the page need scripts? (fixed values) ----------------------------------

# name: (marks in the page, parts of script addresses)
FRAMEWORKS = {
    "React": (("__REACT_DEVTOOLS_GLOBAL_HOOK__", "data-reactroot", "data-react-helmet", "react-root"), ("react", "react-dom")),
    "Next.js": (("__NEXT_DATA__", "_N_E", "__next"), ("_next/static", "next/dist")),
    "Vue": (("data-v-", "__VUE__", "data-server-rendered"), ("vue.js", "vue.runtime")),
    "Nuxt": (("__NUXT__", "$nuxt", "nuxt-link"), ("_nuxt/",)),
    "Angular": (("ng-version", "_nghost", "_ngcontent"), ("angular", "@angular")),
    "Svelte": (("svelte-",), ("svelte",)),
    "Gatsby": (("___gatsby", "gatsby-"), ("webpack-runtime",)),
    "Ember": (("ember-application", "ember-view"), ("ember.js",)),
    "Remix": (("__remix", "__remixContext", "__remix_data"), ("@remix-run", "remix.run")),
    "Solid": (("data-hk", "_$HY"), ("solid-js", "solidjs")),
    "Qwik": (("q:container", "q:version", "q:base"), ("@builder.io/qwik", "qwikloader")),
    "Astro": (("astro-island", "client:load", "client:visible"), ("astro/", "@astrojs")),
}
LAZY_MARKS = ("data-lazy", "lazy-load", "data-lazy-src")
ROUTER_MARKS = ("react-router", "vue-router", "angular/router", "@reach/router", "history.pushState", "history.replaceState")
HYDRATION_MARKS = ("data-reactid", "data-react-checksum", "data-hydrate")
BUNDLE_MARKS = ("_buildManifest", "__webpack", ".chunk.", "chunk-", "vendor.")


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def script_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*\ssrc="([^"]*)"'), F.lit(1))


def frameworks(html: Column) -> Column:
    """Names of the frameworks whose marks or script addresses the page shows."""
    src = F.lower(F.array_join(script_sources(html), "\n"))
    found = [F.when(_has_any(html, marks) | _has_any(src, parts), F.lit(name)) for name, (marks, parts) in FRAMEWORKS.items()]
    return F.array_compact(F.array(*found))


def lazy_loading(html: Column) -> Column:
    inline = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    return _has_any(html, LAZY_MARKS) | _has_any(inline, ("IntersectionObserver", "getBoundingClientRect"))


def script_routing(html: Column) -> Column:
    return _has_any(html, ROUTER_MARKS) | html.rlike(r'<a\s[^>]*href="#/')


def hydration(html: Column) -> Column:
    return _has_any(html, HYDRATION_MARKS)


def minimal_content(html: Column) -> Column:
    """Less than 100 bytes of text (scripts' text included, head excluded), or a root element with nearly none."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<head\b.*?</head>", ""), "<[^>]*>", "")
    root = F.regexp_extract(html, r'(?is)<div[^>]*\sid="(?:root|app|__next|application)"[^>]*>(.*?)</div>', 1)
    has_root = html.rlike(r'(?is)<div[^>]*\sid="(?:root|app|__next|application)"')
    return (F.octet_length(F.trim(body)) < 100) | (has_root & (F.octet_length(F.trim(F.regexp_replace(root, "<[^>]*>", ""))) < 50))


def generic_shell(html: Column) -> Column:
    """An empty root element with scripts, or two of: three module scripts, a
    bundle among the sources, a notice that scripts are needed."""
    root = F.regexp_extract(html, r'(?is)<div[^>]*\sid="(?:root|app|__app|application)"[^>]*>(.*?)</div>', 1)
    has_root = html.rlike(r'(?is)<div[^>]*\sid="(?:root|app|__app|application)"')
    empty = has_root & (F.octet_length(F.trim(F.regexp_replace(root, "<[^>]*>", ""))) < 20) & html.contains("<script")
    src = F.array_join(script_sources(html), "\n")
    modules = F.size(F.regexp_extract_all(html, F.lit(r'(?i)(<script[^>]*type="module")'), F.lit(1))) >= 3
    bundle = _has_any(src, BUNDLE_MARKS) | src.rlike(r"app\.[0-9a-f]{6,}")
    notice = F.lower(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), F.lit(1)), "\n")).rlike("javascript|enable")
    return empty | (modules.cast("int") + bundle.cast("int") + notice.cast("int") >= 2)


def needs_scripts(html: Column) -> dict[str, Column]:
    """Verdict, reason, frameworks and ratio of a page."""
    names, ratio = frameworks(html), script_ratio(html)
    minimal, shell = minimal_content(html), generic_shell(html)
    reasons = F.array_compact(
        F.concat(
            F.transform(names, lambda n: F.concat(F.lit("Framework detected: "), n)),
            F.array(
                F.when(lazy_loading(html), F.lit("Lazy loading indicators found")),
                F.when(script_routing(html), F.lit("SPA routing detected")),
                F.when(ratio < 0.5, F.lit("Low content/script ratio")),
                F.when(minimal, F.lit("Minimal initial content (SPA shell)")),
                F.when(hydration(html), F.lit("Hydration markers detected")),
                F.when(shell, F.lit("Generic SPA signals detected")),
            ),
        )
    )
    strong = F.size(names) + F.size(reasons)
    verdict = minimal | shell | ((strong >= 3) & (ratio < 0.3))
    joined = F.array_join(reasons, "; ")
    reason = (
        F.when(verdict, joined)
        .when(strong > 0, F.concat(F.lit("Signals detected but insufficient to trigger browser: "), joined))
        .otherwise(F.lit("Static content with sufficient initial HTML"))
    )
    return {"needs_scripts": verdict, "reason": reason, "detected_frameworks": names, "content_script_ratio": ratio}


# ---- gates (fixed values) --------------------------------------------------------

BLOCK_PHRASES = ("access denied", "blocked", "captcha", "cloudflare", "challenge", "please verify", "bot detection")
PAGE_MARKS = ('<meta property="og:type"', '<meta property="og:title"', '<meta name="description"', "application/ld+json", '<meta property="twitter:card"')
ERROR_TITLES = ("<title>404", "<title>error", "<title>not found", "<title>access denied", "<title>forbidden")
ERROR_HEADINGS = ("<h1>404", "<h1>error", "<h1>not found", "<h1>access denied", "<h2>404", "<h2>error", "<h2>not found")
ERROR_PHRASES = ("this page doesn't exist", "the page you are looking for does not exist", "the page you requested could not be found")


def wants_browser(html: Column, status: Column) -> Column:
    """Statuses of blocking, or another failure whose page speaks of it."""
    return F.coalesce(status.isin(401, 403, 429, 503) | ((status >= 400) & _has_any(F.lower(html), BLOCK_PHRASES)), F.lit(False))


def has_page_marks(html: Column) -> Column:
    n = F.lit(0)
    for m in PAGE_MARKS:
        n = n + html.contains(m).cast("int")
    return F.coalesce(n >= 2, F.lit(False))


def is_error_page(html: Column, status: Column) -> Column:
    """By status; a successful page only with two kinds of evidence and without
    the marks of a real page."""
    low = F.lower(html)
    kinds = _has_any(low, ERROR_TITLES).cast("int") + _has_any(low, ERROR_HEADINGS).cast("int") + _has_any(low, ERROR_PHRASES).cast("int")
    good = (status >= 200) & (status < 300) & ~has_page_marks(html) & (kinds >= 2)
    return F.coalesce((status >= 400) | good, F.lit(False))


def quality_error(html: Column, markdown: Column, status: Column) -> Column:
    """Why a page fails the quality gate; null where it passes."""
    return quality_error_of(text_density(html) < 0.05, is_error_page(html, status), markdown, status)


def quality_error_of(sparse: Column, error_page: Column, markdown: Column, status: Column) -> Column:
    """The same from what was seen of the page before."""
    good = F.coalesce(((status >= 200) & (status < 300)) | (status == 304), F.lit(False))
    size = F.coalesce(F.octet_length(trim_all(markdown)), F.lit(0))
    return F.when(size <= 100, F.lit("empty_content")).when(sparse & ~good, F.lit("low_quality")).when(error_page, F.lit("error_page"))


def is_thin(html: Column, least: int = 100) -> Column:
    """Whether a page shows so little text that a browser should read it again."""
    return F.coalesce(F.octet_length(plain_text(html)), F.lit(0)) < least
