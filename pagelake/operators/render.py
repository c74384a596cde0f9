"""HTML to Markdown: main content, images, tables, and a tree renderer.

Pure Python; ``operators.pages`` wraps it in Arrow batches.
"""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

from .htmltree import BLOCK, Element, matches, parse, select, select_first
from .residual import drop_bloating_tables, thin_out_tables

# Places of main content, best first (fixed values).
MAIN_SELECTORS = (
    "#readme",
    ".markdown-body",
    "#mw-content-text",
    ".mw-parser-output",
    "main article",
    "[role='main'] article",
    ".docs-content",
    ".doc-content",
    "[data-docs-content]",
    ".prose",
    ".article-body",
    "main",
    "article",
    "[role='main']",
    ".main-content",
    "#main-content",
    ".content",
    "#content",
    ".post-content",
    ".entry-content",
    ".article-content",
    ".page-content",
    ".body-content",
    "#inside",
    ".stories",
    ".itemlist",
)
# What to take off where no such place is found (fixed values).
NOISE_SELECTORS = (
    ".Layout-sidebar, .file-navigation, .BorderGrid, .Layout-sidebar-left, .Layout-sidebar-right, .repository-content, .file-tree, .js-file-line-container, .blob-wrapper, .contributors-wrapper, .discussion-sidebar,"
    "nav, header, footer, aside, .navigation, .sidebar, .menu, .header, .footer, #header, #footer, #navigation,"
    ".docs-sidebar, .doc-sidebar, .sidebar-nav, .toc-sidebar, .page-sidebar, .left-sidebar, .side-nav, .sidenav, #sidebar, #toc,"
    "[role='navigation'], [role='complementary'], .toc, .table-of-contents, .skip-link, .skip-to-content,"
    ".mw-editsection, #mw-panel, #mw-head, .navbox, .catlinks, .mw-indicators, .sistersitebox, #p-lang-btn, .vector-page-toolbar, .vector-column-start,"
    ".cookie-banner, .cookie-consent, .cookie-notice, #cookie-banner, #cookie-consent, .share-buttons, .social-share, .social-links, .ad, .advertisement, .ads,"
    ".breadcrumb, .breadcrumbs, .search-form, .search-box, .modal, .popup, #modal, .overlay, .widget, #widget, .lang-selector, .language, #language-selector,"
    ".top-bar, .bottom-bar, .gh-header, #gh-header, script, style, noscript, svg,"
    "[class*='cookie'], [aria-label='breadcrumb'], [class*='cart'], [class*='wishlist'], [class*='account-'], [class*='sponsored'], [class*='banner'], [class*='notification'], [class*='alert']"
)
NESTED_NOISE = "nav, aside, [role='navigation'], [class*='sidebar']"
DROP = frozenset("script style noscript svg head template iframe object".split())
LAZY_SOURCES = ("data-src", "data-lazy-src", "data-original", "data-lazy-load")
_SPACE = re.compile(r"[ \t\r\n\f]+")


def srcset_largest(srcset: str) -> str | None:
    """The widest source, the first of equals."""
    best, width = None, -1.0
    for part in srcset.split(","):
        bits = part.split()
        if not bits:
            continue
        w = 0.0
        if len(bits) > 1:
            d = bits[-1]
            try:
                w = float(d[:-1]) * (600 if d.endswith("x") else 1) if d[-1] in "wx" else 0.0
            except ValueError:
                w = 0.0
        if w > width:
            best, width = bits[0], w
    return best


def image_source(img: Element) -> str | None:
    """The real source of an image: the largest of a srcset, a lazy one, the plain one."""
    if img.attrs.get("srcset") and (best := srcset_largest(img.attrs["srcset"])):
        return best
    src = img.attrs.get("src", "")
    if not src or src.startswith("data:"):
        for name in LAZY_SOURCES:
            if img.attrs.get(name):
                return img.attrs[name]
    return src or None


def prepare_images(root: Element) -> None:
    """Pictures to their best image, images of a noscript to the page, posters to images."""
    for pic in select(root, "picture"):
        img = select_first(pic, "img")
        best = None
        for s in select(pic, "source"):
            best = srcset_largest(s.attrs.get("srcset", "")) or best
        if img is None:
            img = Element("img", {}, pic)
            pic.children.append(img)
        if best:
            img.attrs["src"] = best
            img.attrs.pop("srcset", None)
    have = {e.attrs.get("src") for e in select(root, "img")}
    for ns in select(root, "noscript"):
        inner = parse(ns.text())
        for img in select(inner, "img"):
            if ns.parent is not None and img.attrs.get("src") and img.attrs["src"] not in have:
                img.parent = ns.parent
                ns.parent.children.insert(ns.parent.children.index(ns) + 1, img)
    for v in select(root, "video[poster]"):
        if v.parent is not None:
            v.parent.children.insert(v.parent.children.index(v) + 1, Element("img", {"src": v.attrs["poster"], "alt": "Video poster"}, v.parent))


def flatten_layout_tables(root: Element) -> None:
    """Tables that only lay out a page (spacing attributes, no header cells) to blocks."""
    for t in select(root, "table"):
        if ("cellpadding" in t.attrs or "cellspacing" in t.attrs or t.attrs.get("border") == "0") and not select(t, "th"):
            for e in t.walk():
                if e.tag in ("table", "tbody", "tr", "td"):
                    e.tag = "div"


_SIMPLE = {s for s in MAIN_SELECTORS if " " not in s and "[" not in s}


def _main_candidates(root: Element) -> dict[str, Element]:
    """The first match of every main selector, in one walk."""
    found: dict[str, Element] = {}
    for e in root.walk():
        if e is root:
            continue
        keys = [e.tag, *("." + c for c in e.classes)]
        if "id" in e.attrs:
            keys.append("#" + e.attrs["id"])
        for k in keys:
            if k in _SIMPLE:
                found.setdefault(k, e)
        if e.attrs.get("role") == "main":
            found.setdefault("[role='main']", e)
        if "data-docs-content" in e.attrs:
            found.setdefault("[data-docs-content]", e)
        if e.tag == "article" and ("main article" not in found or "[role='main'] article" not in found):
            up = e.parent
            while up is not None:
                if up.tag == "main":
                    found.setdefault("main article", e)
                if up.attrs.get("role") == "main":
                    found.setdefault("[role='main'] article", e)
                up = up.parent
    return found


def main_content(root: Element, size: int) -> Element:
    """The first listed place that makes up a tenth of the page; else the page
    without noise.  Navigation nested inside goes in either case."""
    found = _main_candidates(root)
    for s in MAIN_SELECTORS:
        e = found.get(s)
        if e is not None and len(e.outer()) >= size / 10:
            for x in select(e, NESTED_NOISE):
                x.remove()
            return e
    for e in select(root, NOISE_SELECTORS):
        e.remove()
    return root


def keep_tags(root: Element, include: list[str], exclude: list[str]) -> Element:
    """Only what the include selectors match, without what the exclude ones do."""
    if include:
        kept = Element("#root")
        chosen: list[Element] = []
        for e in root.walk():
            if e is not root and any(matches(e, s) for s in include):
                up = e.parent
                while up is not None and up not in chosen:
                    up = up.parent
                if up is None:
                    chosen.append(e)
        for e in chosen:
            e.parent = kept
            kept.children.append(e)
        root = kept
    for s in exclude:
        for e in select(root, s):
            e.remove()
    return root


def own_rows(table: Element) -> list[Element]:
    """Rows of a table without those of tables inside it."""
    out: list[Element] = []
    stack = list(reversed(table.elements()))
    while stack:
        e = stack.pop()
        if e.tag == "tr":
            out.append(e)
        elif e.tag in ("thead", "tbody", "tfoot"):
            stack.extend(reversed(e.elements()))
    return out


class Renderer:
    """One pass over a tree; relative addresses are resolved against ``base``."""

    def __init__(self, base: str = ""):
        self.base = base

    def url(self, u: str) -> str:
        if not self.base or u.startswith(("data:", "mailto:", "tel:", "javascript:")):
            return u
        if u.startswith(("https://", "http://")) and "/../" not in u:
            return u
        try:
            return urljoin(self.base, u)
        except ValueError:
            return u

    def inline(self, e: Element) -> str:
        out: list[str] = []
        for c in e.children:
            if isinstance(c, str):
                out.append(_SPACE.sub(" ", c))
                continue
            t = c.tag
            if t in DROP:
                continue
            if t == "br":
                out.append("\n")
            elif t in ("strong", "b"):
                out.append(self._wrap(self.inline(c), "**"))
            elif t in ("em", "i"):
                out.append(self._wrap(self.inline(c), "*"))
            elif t in ("code", "kbd", "samp", "tt"):
                s = c.text()
                out.append(f"`{s}`" if s.strip() else "")
            elif t in ("del", "s", "strike"):
                out.append(self._wrap(self.inline(c), "~~"))
            elif t == "img":
                src = image_source(c)
                if src:
                    out.append(f"![{_SPACE.sub(' ', c.attrs.get('alt', '')).strip()}]({'data:image-removed' if src.startswith('data:') else self.url(src)})")
            elif t == "a":
                text = _SPACE.sub(" ", self.inline(c)).strip()
                href = c.attrs.get("href", "")
                out.append(f"[{text}]({self.url(href)})" if text and href else text)
            elif t in BLOCK:
                out.append("\n" + self.inline(c).strip() + "\n")
            else:
                out.append(self.inline(c))
        return "".join(out)

    @staticmethod
    def _wrap(s: str, mark: str) -> str:
        core = s.strip()
        if not core:
            return s
        lead, tail = s[: len(s) - len(s.lstrip())], s[len(s.rstrip()) :]
        return f"{lead}{mark}{core}{mark}{tail}"

    def blocks(self, e: Element, depth: int = 0) -> list[str]:
        out: list[str] = []
        run = Element("span")

        def flush() -> None:
            if run.children:
                s = re.sub(r" *\n *", "\n", self.inline(run)).strip()
                if s:
                    out.append(s)
                run.children = []

        for c in e.children:
            if isinstance(c, str) or c.tag not in BLOCK and not any(x.tag in BLOCK for x in c.walk()):
                run.children.append(c)
                continue
            flush()
            t = c.tag
            if t in DROP:
                continue
            if t[0] == "h" and len(t) == 2 and t[1].isdigit():
                s = _SPACE.sub(" ", self.inline(c)).strip()
                if s:
                    out.append(f"{'#' * int(t[1])} {s}")
            elif t == "pre":
                code = select_first(c, "code")
                names = " ".join((code or c).classes)
                lang = re.search(r"(?:language|lang|highlight-source)-([\w+#-]+)", names)
                out.append(f"```{lang.group(1) if lang else ''}\n{c.text().strip(chr(10))}\n```")
            elif t in ("ul", "ol"):
                if s := self.list(c, depth):
                    out.append(s)
            elif t == "blockquote":
                inner = "\n\n".join(self.blocks(c, depth))
                if inner:
                    out.append("\n".join(("> " + x).rstrip() for x in inner.split("\n")))
            elif t == "table":
                if s := self.table(c):
                    out.append(s)
            elif t == "hr":
                out.append("---")
            else:
                out += self.blocks(c, depth)
        flush()
        return out

    def list(self, e: Element, depth: int) -> str:
        rows: list[str] = []
        n = 0
        for li in e.elements():
            if li.tag in ("ul", "ol"):
                rows.append(self.list(li, depth + 1))
                continue
            if li.tag in DROP:
                continue
            n += 1
            parts = self.blocks(li, depth + 1)
            if not parts:
                continue
            mark = f"{n}. " if e.tag == "ol" else "* "
            pad = "  " * depth
            body = "\n".join(p if p.lstrip().startswith(("* ", "1. ")) else p.replace("\n", "\n" + pad + "  ") for p in parts)
            rows.append(f"{pad}{mark}{body}")
        return "\n".join(r for r in rows if r)

    def table(self, e: Element) -> str:
        rows = [[self.cell(c) for c in tr.elements() if c.tag in ("td", "th")] for tr in own_rows(e)]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        out = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * width]
        return "\n".join(out + ["| " + " | ".join(r) + " |" for r in rows[1:]])

    def cell(self, e: Element) -> str:
        return _SPACE.sub(" ", self.inline(e)).strip().replace("|", "\\|")


_SEPARATORS = re.compile(r"\n{3,}")


def to_markdown(
    source: str | None, base: str = "", only_main: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, tree: Element | None = None
) -> str | None:
    """Markdown of a page.  JSON bodies come fenced, plain text as it is; a main
    part with under 50 bytes is taken again from the whole page; a text without
    headings gets the title on top.  ``tree``: the parsed page, which is used up."""
    if source is None:
        return None
    s = source.strip()
    if s[:1] in "{[" and s:
        try:
            json.loads(s)
        except ValueError:
            pass
        else:
            return f"# JSON Response\n\n```json\n{s}\n```"
    if "<" not in s:
        return s
    thin = thin_out_tables(source)
    if thin is not source and thin != source:
        source, tree = thin, None
    root = tree if tree is not None else parse(source)
    title = select_first(root, "title")
    prepare_images(root)
    flatten_layout_tables(root)
    if include or exclude:
        root = keep_tags(root, include or [], exclude or [])
    out = _render(main_content(root, len(source)) if only_main else root, base)
    lean = drop_bloating_tables(source, out)
    if lean is not None:
        whole = parse(lean)
        prepare_images(whole)
        flatten_layout_tables(whole)
        if include or exclude:
            whole = keep_tags(whole, include or [], exclude or [])
        out = _render(main_content(whole, len(lean)) if only_main else whole, base)
    if only_main and len(out.encode()) < 50:
        whole = parse(source)
        prepare_images(whole)
        flatten_layout_tables(whole)
        if include or exclude:
            whole = keep_tags(whole, include or [], exclude or [])
        out = _render(whole, base)
    if title is not None and not re.search(r"^\s*#", out, re.M):
        t = _SPACE.sub(" ", title.text()).strip()
        out = f"# {t}\n\n{out}".strip() if t else out
    return out


def _render(e: Element, base: str) -> str:
    return _SEPARATORS.sub("\n\n", "\n\n".join(Renderer(base).blocks(e))).strip()


# ---- parts of a page -----------------------------------------------------------------


def meta_content(root: Element, name: str, attribute: str = "name") -> str | None:
    for e in select(root, "meta"):
        if e.attrs.get(attribute) == name and (v := e.attrs.get("content", "").strip()):
            return v
    return None


def looks_like_navigation(text: str) -> bool:
    low = text.lower()
    return low.startswith(("skip to", "menu", "search")) or len(text.encode()) < 150 and text.count("\n") > 5


def first_paragraph(root: Element) -> str | None:
    """The first block of over 80 bytes that isn't navigation, paragraphs before
    other blocks; cut at a space within 200 bytes."""
    for tag in ("p", "div", "font", "td", "li"):
        for e in select(root, tag):
            t = e.text(frozenset(("script", "style"))).strip()
            if len(t.encode()) > 80 and not looks_like_navigation(t):
                if len(t.encode()) <= 200:
                    return t
                head = t.encode()[:200].decode("utf-8", "ignore")
                return (head.rsplit(" ", 1)[0] if " " in head else head) + "..."
    return None


def metadata(source: str | Element | None, url: str | None = None) -> dict[str, str | None]:
    """Title, description, language, keywords, robots, Open Graph and canonical link."""
    root = source if isinstance(source, Element) else parse(source or "")
    title = select_first(root, "title")
    html = select_first(root, "html")
    canonical = select_first(root, "link[rel='canonical']")
    return {
        "title": (title.text().strip() or None) if title else None,
        "description": meta_content(root, "description") or meta_content(root, "description", "property") or meta_content(root, "og:description", "property")
        or meta_content(root, "twitter:description") or first_paragraph(root),
        "language": html.attrs.get("lang") if html else None,
        "keywords": meta_content(root, "keywords"),
        "robots": meta_content(root, "robots"),
        "og_title": meta_content(root, "og:title", "property"),
        "og_description": meta_content(root, "og:description", "property"),
        "og_url": meta_content(root, "og:url", "property"),
        "og_image": meta_content(root, "og:image", "property"),
        "url": url,
        "canonical_url": canonical.attrs.get("href") if canonical else None,
    }


def links(source: str | Element | None, base: str) -> list[str]:
    r = Renderer(base)
    root = source if isinstance(source, Element) else parse(source or "")
    return [r.url(e.attrs["href"]) for e in select(root, "a") if e.attrs.get("href")]


def images(source: str | Element | None, base: str) -> list[str]:
    r = Renderer(base)
    root = source if isinstance(source, Element) else parse(source or "")
    found = [image_source(e) for e in select(root, "img")]
    return [r.url(u) for u in found if u and not u.startswith("data:")]


def tables(source: str | None) -> list[tuple[list[str], list[dict[str, str]]]]:
    """(headers, rows) of each table; headers from thead or the first row, or
    numbered columns."""
    out = []
    for t in select(parse(source or ""), "table"):
        trs = own_rows(t)
        rows = [[_SPACE.sub(" ", c.text()).strip() for c in tr.elements() if c.tag in ("td", "th")] for tr in trs]
        head = next((tr for tr in trs if tr.parent is not None and tr.parent.tag == "thead"), None)
        if head is not None:
            k = trs.index(head)
        else:
            k = next((i for i, tr in enumerate(trs) if any(c.tag == "th" for c in tr.elements())), -1)
        headers = rows[k] if k >= 0 else [f"Column {i + 1}" for i in range(max(map(len, rows), default=0))]
        body = [r for i, r in enumerate(rows) if i != k and r]
        out.append((headers, [{headers[i] if i < len(headers) and headers[i] else f"Column {i + 1}": v for i, v in enumerate(r)} for r in body]))
    return out


def content_quality(source: str | None) -> tuple[int, int, float]:
    """(visible bytes, bytes outside navigation, share of navigation)."""
    root = parse(source or "")
    body = select_first(root, "body") or root
    skip = frozenset(("script", "style", "noscript"))
    nav_tags = ("nav", "header", "footer", "aside")
    total: list[str] = []
    nav: list[str] = []

    def go(e: Element, inside: bool) -> None:
        if e.tag in skip:
            return
        inside = inside or e.tag in nav_tags or e.attrs.get("role") in ("navigation", "banner", "contentinfo")
        for c in e.children:
            if isinstance(c, str):
                total.append(c)
                if inside:
                    nav.append(c)
            else:
                go(c, inside)

    go(body, False)
    n, k = len("".join(total).strip().encode()), len("".join(nav).strip().encode())
    return n, max(0, n - k), k / n if n else 0.0


# ---- selector extraction ---------------------------------------------------------------


def _text_of(e: Element) -> str:
    """The content attribute, the value attribute or the text of an element."""
    return (e.attrs.get("content") or e.attrs.get("value") or e.text()).strip()


def _number(text: str) -> float | None:
    try:
        return float(re.sub(r"[^0-9.\-]", "", text))
    except ValueError:
        return None


def _coerce(text: str, kind: str):
    if kind in ("number", "integer"):
        return _number(text)
    if kind == "boolean":
        return text.lower() in ("true", "yes", "1")
    return text


def extract(source: str | None, selectors: dict[str, str], schema: dict | None = None) -> dict:
    """Fields by selector; types from the properties of a JSON schema: string,
    number, integer, boolean or array (of its items' type).  Missing is null."""
    root = parse(source or "")
    props = (schema or {}).get("properties", {})
    out: dict = {}
    for name, selector in selectors.items():
        want = props.get(name, {})
        kind = want.get("type", "string")
        if kind == "array":
            item = want.get("items", {}).get("type", "string")
            out[name] = [_coerce(_text_of(e), item) for e in select(root, selector)]
            continue
        e = select_first(root, selector)
        out[name] = None if e is None else _coerce(_text_of(e), kind)
    return out


def completeness(fields: dict) -> float:
    """Share of fields that aren't null; 0 for none."""
    return sum(v is not None for v in fields.values()) / len(fields) if fields else 0.0


# ---- pagination -------------------------------------------------------------------------

_PAGE = re.compile(r"(?:/page/|[?&](?:page|p)=)(\d+)")


def page_number(url: str) -> int | None:
    m = _PAGE.search(url)
    return int(m.group(1)) if m and int(m.group(1)) < 1 << 32 else None


# Marks of a link to the next page, and of a next button that leads nowhere (fixed values).
NEXT_TEXT = ("next", "→", "»", "›")
LAST_PAGE = (
    "a[rel='next'][disabled], button.next[disabled], .next[disabled]",
    ".next.disabled, .pager-next.disabled, .pagination-next.disabled",
)


def is_last_page(root: Element) -> bool:
    """Whether a disabled next button shows that no page follows."""
    if any(select(root, s) for s in LAST_PAGE):
        return True
    return any("next" in e.attrs.get("aria-label", "").lower() and (e.attrs.get("aria-disabled") == "true" or "disabled" in e.attrs) for e in select(root, "[aria-label]"))


def pagination_links(source: str | None, url: str, circular: bool = False) -> list[str]:
    """Next pages: the first rel=next link, links whose text or class says next,
    links whose text is a number above the current page, and the address with its
    number raised.  None on a last page; pages numbered no higher than the
    current one only if ``circular``."""
    root = parse(source or "")
    if is_last_page(root):
        return []
    r = Renderer(url)
    found: list[str] = []
    first = next((e for e in select(root, "link[rel='next'], a[rel='next']") if e.attrs.get("href")), None)
    if first is not None:
        found.append(r.url(first.attrs["href"]))
    current = page_number(url)
    numbered: list[str] = []
    for a in select(root, "a"):
        href = a.attrs.get("href")
        if href is None:
            continue
        text, names = a.text().strip().lower(), a.attrs.get("class", "")
        if (any(x in text for x in NEXT_TEXT) or "next" in names or "pager" in names) and not href.startswith("javascript:") and href != "#":
            found.append(r.url(href))
        if text.isdigit() and int(text) < 1 << 32 and (current is None or int(text) > current):
            numbered.append(r.url(href))
    if current is not None:
        m = _PAGE.search(url)
        found.append(url[: m.start(1)] + str(current + 1) + url[m.end(1) :])
    out = [u for u in dict.fromkeys(found + numbered) if u != url]
    if circular or current is None:
        return out
    return [u for u in out if (n := page_number(u)) is None or n > current]


def search_results(source: str | None) -> list[tuple[str, str, str]]:
    """(title, address, snippet) of a search engine's result page."""
    from urllib.parse import parse_qs, urlparse

    out = []
    for e in select(parse(source or ""), ".result"):
        a = select_first(e, ".result__a")
        s = select_first(e, ".result__snippet")
        if a is None:
            continue
        u = a.attrs.get("href", "")
        target = parse_qs(urlparse(u).query).get("uddg", [u])[0]
        if target.startswith("http"):
            out.append((_SPACE.sub(" ", a.text()).strip(), target, _SPACE.sub(" ", s.text()).strip() if s is not None else ""))
    return out
