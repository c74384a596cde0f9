"""Markdown that still holds HTML, and pages that are mostly tables.

One scan over the tags of a text replaces each by what it means in Markdown;
code is put aside first, so that what it shows is left alone.  Pure Python,
linear in the text; ``clean_residual`` runs it over a table in Arrow batches.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import DataFrame

from ..functions.scalars import ENTITIES
from .arrow import map_rows, pick, spread

_FENCE = re.compile(r"```[^\n]*\n.*?```", re.S)
_SPAN = re.compile(r"`[^`\n]+?`")
_HELD = re.compile("\ue000(\\d+)\ue001")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s|/)[^<>]*)?>")
_ANY_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_SPECIAL = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?xml", "?>"))
_DOCTYPE = re.compile(r"<!doctype[^<>]*>", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_LANGUAGE = re.compile(r"\blang(?:uage)?-([\w+#-]+)")
_AROUND = re.compile(r"[a-zA-Z.,;:!?\s`]")

# What a tag becomes, opened or closed (fixed values of the Markdown that is wanted); any other known tag becomes nothing.
OPENED = {"em": "_", "i": "_", "strong": "**", "b": "**", "code": "`", "li": "- ", "th": " | ", "td": " ", "dd": "  ", "hr": "\n---\n", "br": "\n"}
CLOSED = {"em": "_", "i": "_", "strong": "**", "b": "**", "code": "`", "li": "\n", "th": " | ", "td": " ", "dd": "  "}
LINES = frozenset("p ul ol table tr caption blockquote pre dl dt".split())
DROPPED = frozenset("script style noscript iframe object template".split())  # with what they hold
INLINE = frozenset("em strong b i u s code kbd samp var mark small sup sub abbr cite dfn time data del ins q".split())
KNOWN = (
    frozenset(
        "div span section article header footer nav main aside button form input select option textarea label fieldset legend a img thead tbody tfoot colgroup col meta link title base head body html"
        " picture video audio source track canvas figure figcaption details summary dialog address wbr ruby rt rp bdi bdo embed param slot h1 h2 h3 h4 h5 h6".split()
    )
    | LINES
    | DROPPED
    | INLINE
    | set(OPENED)
)


def decode(text: str) -> str:
    for a, b in ENTITIES:
        text = text.replace(a, b)
    return text


def _attributes(text: str | None) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _ATTRIBUTE.finditer(text or "")}


class _Shelf:
    """Pieces of code that wait behind a private character."""

    def __init__(self) -> None:
        self.pieces: list[str] = []

    def put(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"\ue000{len(self.pieces) - 1}\ue001"

    def restore(self, text: str) -> str:
        while "\ue000" in text:  # code may hold code that was put aside before
            after = _HELD.sub(lambda m: self.pieces[int(m[1])], text)
            if after == text:
                break
            text = after
        return text


def _without_special(text: str) -> str:
    for start, end in _SPECIAL:
        out, pos = [], 0
        while (at := text.find(start, pos)) >= 0 and (stop := text.find(end, at)) >= 0:
            out.append(text[pos:at])
            pos = stop + len(end)
        text = "".join(out) + text[pos:]
    return _DOCTYPE.sub("", text)


def _code_blocks(text: str, shelf: _Shelf) -> str:
    """``pre`` elements as fences, with the language that their class names."""
    out, pos = [], 0
    low = text.lower()
    while (at := low.find("<pre", pos)) >= 0 and (end := low.find("</pre>", at)) >= 0:
        head = text.find(">", at)
        if low[at + 4 : at + 5] not in (">", " ", "\n", "\t") or head > end:
            out.append(text[pos : at + 4])
            pos = at + 4
            continue
        body, language = text[head + 1 : end], ""
        m = re.match(r"\s*<code([^<>]*)>(.*?)(?:</code>\s*)?$", body, re.S | re.I)
        if m:
            found = _LANGUAGE.search(m[1])
            body, language = m[2], found[1] if found else ""
        body = decode(_ANY_TAG.sub("", body)).strip()
        out += [text[pos:at], shelf.put(f"\n```{language}\n{body}\n```\n") if body else ""]
        pos = end + 6
    return "".join(out) + text[pos:]


def clean_html_residue(text: str | None) -> str | None:
    """Markdown without HTML: ``pre`` as fences, links and images in their
    Markdown form, emphasis, lists and breaks kept, element names that a sentence
    speaks of in backticks, everything else taken out.  Code is left alone."""
    if text is None or "<" not in text and "&" not in text:
        return text
    shelf = _Shelf()
    s = text.replace("\ue000", "").replace("\ue001", "")
    s = _FENCE.sub(lambda m: shelf.put(m[0]), s)
    s = _SPAN.sub(lambda m: shelf.put(m[0]), s)
    s = _without_special(_code_blocks(s, shelf))
    out: list[str] = []
    links: list[tuple[int, str]] = []  # where the text of each open link begins, its target
    pos = 0
    skip = ""  # the element that is dropped with all it holds
    for m in _TAG.finditer(s):
        close, name, rest = m[1], m[2].lower(), m[3]
        if skip:
            if close and name == skip:
                skip, pos = "", m.end()
            continue
        out.append(s[pos : m.start()])
        pos = m.end()
        bare = rest is None
        if name in DROPPED and not close and not (rest or "").endswith("/") and re.search(rf"</{name}\s*>", s[m.end() :], re.I):
            skip = name
        elif name == "a":
            if not close:
                links.append((len(out), _attributes(rest).get("href", "")))
            elif links:
                at, href = links.pop()
                inner = "".join(out[at:]).strip()
                del out[at:]
                out.append(inner if not inner or not href or href.lower().startswith("javascript:") else f"[{inner}]({href})")
        elif name == "img":
            a = _attributes(rest)
            out.append(f"![{a.get('alt', '')}]({a['src']})" if a.get("src") else "")
        elif bare and name not in INLINE and (name not in KNOWN or _spoken_of(s, m)):
            out.append(shelf.put(f"`{m[0]}`"))
        elif name in LINES:
            out.append("\n")
        else:
            out.append((CLOSED if close else OPENED).get(name, ""))
    if not skip:
        out.append(s[pos:])
    s = re.sub(r"\n{3,}", "\n\n", "".join(out))
    return shelf.restore(_ANY_TAG.sub("", decode(s)))


def _spoken_of(s: str, m: re.Match) -> bool:
    """A tag in running text, or in the text of a Markdown link."""
    before, after = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
    if before and after and before != "\n" and after != "\n" and _AROUND.match(before) and _AROUND.match(after):
        return True
    line = s.rfind("\n", 0, m.start()) + 1
    opened = s.rfind("[", line, m.start())
    return opened >= 0 and s.find("]", opened, m.start()) < 0 and s.find("](", m.end(), m.end() + 1000) >= 0 and s.find("\n", m.end(), s.find("](", m.end())) < 0


_ESCAPED = re.compile(r"\\</?[a-zA-Z!][^\n>]*?\\?>")
_ROOT_CSS = re.compile(r":root\{--[^}]+\}")


def drop_escapes(text: str) -> str:
    """Without escaped tags, escaped spaces and backslashes, and root style rules."""
    return _ROOT_CSS.sub("", _ESCAPED.sub("", text).replace("\\ ", " ").replace("\\\\", ""))


_LINK_TEXT = re.compile(r"\[([^\]]+)\]\(")


def halve_link_text(text: str) -> str:
    """Link texts that say the same twice say it once."""

    def once(m: re.Match) -> str:
        words = m[1].split()
        half, odd = divmod(len(words), 2)
        same = half and not odd and words[:half] == words[half:]
        return f"[{' '.join(words[:half]) if same else m[1].strip()}]("

    return _LINK_TEXT.sub(once, text)


def limit_item_runs(text: str, most: int = 2) -> str:
    """At most ``most`` equal list items in a row, blank lines between them or not."""
    out: list[str] = []
    last, n = None, 0
    for line in text.split("\n"):
        s = line.strip()
        if s[:2] in ("* ", "- "):
            n = n + 1 if s == last else 1
            last = s
            if n > most:
                continue
        elif s:
            last = None
        out.append(line)
    return "\n".join(out)


def join_link_lines(text: str) -> str:
    """Line ends inside brackets become spaces, however deep the brackets are."""
    out, pos, depth = [], 0, 0
    for m in re.finditer(r"[\[\]\n]", text):
        c = m[0]
        if c == "\n" and depth:
            out += [text[pos : m.start()], " "]
            pos = m.end()
        elif c == "[":
            depth += 1
        elif c == "]":
            depth = max(0, depth - 1)
    return "".join(out) + text[pos:]


_TARGET = re.compile(r"(!?)\[([^\]]*)\]\(([^)]+)\)")


def absolute_targets(text: str, base: str) -> str:
    """Relative targets of links and images resolved against the page's address;
    absolute ones, data of images and marks inside the page stay."""

    def absolute(m: re.Match) -> str:
        image, label, target = m[1], m[2], m[3]
        if target.startswith(("http://", "https://", "data:" if image else "#")) or not image and not label:
            return m[0]
        try:
            found = f"https:{target}" if target.startswith("//") else urljoin(base, target)
        except ValueError:
            return m[0]
        return f"{image}[{label}]({found})"

    return _TARGET.sub(absolute, text)


_DATA_CLASSES = ("infobox", "wikitable", "data-table", "sortable")


def _tables(html: str):
    """(start, end) of the tables of a page, each up to the next closing tag."""
    low, pos = html.lower(), 0
    while (at := low.find("<table", pos)) >= 0 and (end := low.find("</table>", at)) >= 0:
        pos = end + 8
        yield at, pos


def thin_out_tables(html: str, least_bytes: int = 50_000) -> str:
    """Of a large page that is half tables or more, the tables without a data
    class, of over 15 rows (50 with header cells), as their bare text."""
    size = len(html.encode())
    if size < least_bytes:
        return html
    found = list(_tables(html))
    if sum(len(html[a:b].encode()) for a, b in found) * 2 < size:
        return html
    out, pos = [], 0
    for a, b in found:
        body = html[a:b]
        rows, head = body.count("<tr"), body.split(">", 1)[0]
        if any(c in head for c in _DATA_CLASSES) or rows <= 15 or "<th" in body and rows <= 50:
            continue
        text = " ".join(x.strip() for x in _ANY_TAG.split(body) if x.strip())
        out += [html[pos:a], f"\n{text}\n"]
        pos = b
    return "".join(out) + html[pos:]


def drop_bloating_tables(html: str, markdown: str, least_bytes: int = 10_000) -> str | None:
    """The page without its tables of over 30 rows that aren't data tables, if its
    Markdown came out over three times as large as the page; else None."""
    size = len(html.encode())
    if size <= least_bytes or len(markdown.encode()) <= 3 * size:
        return None
    out, pos = [], 0
    for a, b in _tables(html):
        body = html[a:b]
        if body.count("<tr") > 30 and not any(c in body.split(">", 1)[0] for c in _DATA_CLASSES[:3]):
            out.append(html[pos:a])
            pos = b
    return "".join(out) + html[pos:]


STEPS = (clean_html_residue, drop_escapes, join_link_lines, halve_link_text, limit_item_runs)


def clean_text(text: str | None, base: str | None = None) -> str | None:
    """All steps in their order; code keeps its lines."""
    if text is None:
        return None
    text = clean_html_residue(text)
    shelf = _Shelf()
    text = _FENCE.sub(lambda m: shelf.put(m[0]), text.replace("\ue000", "").replace("\ue001", ""))
    text = _SPAN.sub(lambda m: shelf.put(m[0]), text)
    for step in STEPS[1:]:
        text = step(text)
    if base:
        text = absolute_targets(text, base)
    return shelf.restore(re.sub(r"\n{3,}", "\n\n", text))


def clean_residual(df: DataFrame, id_col: str, text_col: str, url_col: str | None = None) -> DataFrame:
    """(row_id, markdown): every text after ``clean_text``; null for null."""
    cols = {"i": id_col, "t": text_col} | ({"u": url_col} if url_col else {})

    def run(b: dict[str, list]) -> dict[str, list]:
        return {"row_id": b["i"], "markdown": [clean_text(t, u) for t, u in zip(b["t"], b.get("u") or [None] * len(b["t"]), strict=True)]}

    return map_rows(spread(pick(df, **cols)), run, "row_id BIGINT, markdown STRING")
