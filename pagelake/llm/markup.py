"""Problem 2: markup residue in text documents.

``clean_documents`` turns Markdown and HTML fields into clean text that keeps
headings, lists, code blocks, tables and formulas, and names the foreign markup
each field still shows.  HTML goes through a small DOM: for every node the
characters per tag are computed with link text taken off, the densities of the
children are summed, and in every subtree above the threshold of the path from
the largest sum to the body the node with the largest sum is content.  Leftover
markup is looked for in the visible text of these subtrees, outside code.

Null and empty fields give no finding and a null text.  No shuffle.
"""

from __future__ import annotations

import html as _html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .engine import map_rows, pick, spread
from .lines import find_links, replace_links, without_hidden
from .profile import profile, quality_kind
from .residue import Residue, fit_residue

_TAG_NAMES = (
    "p|br|div|span|b|i|em|strong|a|ul|ol|li|table|tr|td|th|thead|tbody|tfoot|h[1-6]|img|font|center|sup|sub|small|big|u|s|tt|hr|blockquote|code|pre|section|article"
    "|header|footer|nav|main|aside|figure|figcaption|script|style|iframe|form|input|button|label|select|option|dl|dt|dd|del|ins|mark|caption|video|audio|source"
)
# Runs that end at the sign that begins them have any length; others are bounded, so that no text takes quadratic time.
HTML_TAG = re.compile(rf"</?(?:{_TAG_NAMES})(?:\s[^<>]*)?/?>", re.I)
DOCTYPE = re.compile(r"<!doctype\b[^<>]*>", re.I)
ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,6});")
WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^\{\||^\|-\s*$|^\|\}\s*$|'''?[^'\n]+'''?|^={2,6}[^=\n]+={2,6}[ \t]*$", re.M)
LATEX = re.compile(
    r"\\(?:begin|end|section|subsection|textbf|textit|emph|frac|sqrt|cite|ref|eqref|label|mathbb|mathrm|mathcal|footnote|url|href|caption|includegraphics|usepackage|documentclass)\s*\{"
    r"|\\(?:item|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|pi|omega|leq|geq|neq|times|cdot|sum|int|prod|infty|partial|nabla|in|to|ldots|approx)\b"
    r"|\$\$[^$]{1,2000}\$\$|\\\([^\n]{1,500}?\\\)|\\\[[^\]]{1,1000}?\\\]|(?<![\\$\w])\$[^$\n]{0,300}[\\^_][^$\n]{0,300}\$(?!\d)|\\[a-zA-Z]{3,30}\{[^}\n]{0,500}\}"
)
MARKDOWN = re.compile(
    r"(?<![*\w])\*\*[^*\s](?:[^*\n]{0,1000}[^*\s])?\*\*(?![*\w])|!?\[[^\]\n]{1,1000}\]\([^)\s]{1,3000}\)|^\s*#{1,6} \S|^\s*(?:```|~~~)|^\s*\|(?: ?:?-{3,}:? ?\|)+\s*$|^\s*[-*+] \S.*(?:\n\s*[-*+] \S)|^\s*> \S|(?<!`)`[^`\n]{1,1000}`(?!`)",
    re.M,
)
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?^[ \t]*\1[^\n]*$", re.S | re.M)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_AUTOLINK = re.compile(r"<(?:https?|ftp|mailto):[^<>\s]*>|<[\w.+-]+@[\w.-]+>")
_TEMPLATE_FIELD = re.compile(r"\{\{\s*[a-z]+[ ._-][a-z]+\s*\}\}")


def has_comment(text: str) -> bool:
    at = text.find("<!--")
    return at >= 0 and text.find("-->", at) >= 0 or "<!" in text and DOCTYPE.search(text) is not None


def drop_comments(text: str) -> str:
    out, pos = [], 0
    while (at := text.find("<!--", pos)) >= 0 and (end := text.find("-->", at)) >= 0:
        out.append(text[pos:at])
        pos = end + 3
    out.append(text[pos:])
    return DOCTYPE.sub("", "".join(out))


def leftovers(text: str, entities: bool = True) -> list[str]:
    """Kinds of foreign markup (html, latex, wiki) in text whose code and
    autolinks are blanked already."""
    out = []
    if "<" in text and (HTML_TAG.search(text) or has_comment(text)) or entities and "&" in text and ENTITY.search(text):
        out.append("html")
    if ("\\" in text or "$" in text) and LATEX.search(text):
        out.append("latex")
    if ("[[" in text or "{{" in text or "{|" in text or "''" in text or "==" in text or "|-" in text) and WIKI.search(text):
        out.append("wiki")
    return out


def without_code(markdown: str) -> str:
    if "```" in markdown or "~~~" in markdown:
        markdown = _FENCE.sub("", markdown)
    if "`" in markdown:
        markdown = _INLINE.sub(" ", markdown)
    if "<" in markdown:
        markdown = _AUTOLINK.sub(" ", markdown)
    return markdown


# ---- HTML ----------------------------------------------------------------

VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_TOKEN = re.compile(r"<!?(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_BLOCK = frozenset("p div section article header footer nav main aside ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre figure form dl dt dd hr br body html thead tbody".split())


MAX_DEPTH = 200  # deeper elements become siblings


@dataclass
class Node:
    tag: str
    parent: Node | None
    attributes: str = ""
    depth: int = 0
    kids: list = field(default_factory=list)  # Node or str
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0  # sum of the children's densities


def parse(source: str) -> Node:
    """A lenient tree of the body element (of everything where there is none)."""
    source = without_hidden(source)
    root = Node("html", None)
    at, pos = root, 0
    for m in _TOKEN.finditer(source):
        if m.start() > pos:
            at.kids.append(source[pos : m.start()])
        pos = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            up = at
            while up is not root and up.tag != name:
                up = up.parent
            if up is not root:
                at = up.parent
        else:
            if name in ("p", "li", "tr", "td", "th") and at.tag == name:
                at = at.parent
            node = Node(name, at, m.group(3), at.depth + 1)
            at.kids.append(node)
            if name not in VOID and not m.group(3).endswith("/") and node.depth < MAX_DEPTH:
                at = node
    if pos < len(source):
        at.kids.append(source[pos:])
    return next((n for n in _walk(root) if n.tag == "body"), root)


def _walk(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]


def measure(body: Node) -> None:
    """Composite text density of every node and sums over its children."""
    order = list(_walk(body))
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(k.strip())
            else:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    ratio = body.link_chars / max(1, body.chars)
    for n in order:
        c, lc, t, lt = n.chars, n.link_chars, max(1, n.tags), max(1, n.link_tags)
        if not c:
            continue
        plain = max(1, c - lc)
        base = math.log(c / plain * lc + ratio * c + math.e)
        n.density = c / t * math.log(max(1.0001, c / max(1, lc) * t / lt)) / base
    for n in order:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node))


def content_nodes(body: Node) -> list[Node]:
    """The content subtrees, in order.  The threshold is the least density on the
    path from the densest sum to the body; in every subtree that reaches it on
    its own (its parent doesn't) the node with the largest sum is content."""
    nodes = list(_walk(body))
    best = max(nodes, key=lambda n: n.total)
    threshold, n = best.density, best
    while n is not body and n.parent is not None:
        n = n.parent
        threshold = min(threshold, n.density)
    if best.total <= 0:
        return [body]
    out: list[Node] = []
    stack = [body]
    while stack:
        n = stack.pop()
        if n.density >= threshold and n is not body:
            top = max(_walk(n), key=lambda k: k.total)
            out.append(top if top.total > 0 else n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out or [best]


def text_of(n: Node, code: bool = False) -> str:
    """All text below a node, entities decoded; spaces kept in code only."""
    out: list[str] = []
    stack: list = [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif not code and k is not n and k.tag in _INLINE_FORMS:
            out.append(_inline(k))
        else:
            stack += reversed(k.kids)
    text = _html.unescape("".join(out))
    return text if code else re.sub(r"\s+", " ", text)


_INLINE_FORMS = frozenset(("code", "sub", "sup", "math"))


def _inline(n: Node) -> str:
    """Inline code, indices and formulas as text that keeps what they say."""
    t = text_of(n, n.tag == "code") if n.tag == "code" else text_of(Node("", None, kids=n.kids))
    if n.tag == "code":
        return f"`{t}`" if "`" not in t else f"`` {t} ``"
    if n.tag == "math":
        tex = next((k for k in _walk(n) if k.tag == "annotation" and "tex" in k.attributes.lower()), None)
        t = (text_of(tex) if tex else t).strip()
        return f"${t}$" if t else ""
    t = t.strip()
    return ("_" if n.tag == "sub" else "^") + (t if len(t) == 1 else "{" + t + "}") if t else ""


def visible(node: Node) -> str:
    """Text outside code; blocks on lines of their own, entities decoded once."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in ("pre", "code"):
            if n.tag in _BLOCK:
                out.append("\n")
                stack.append("\n")
            stack += reversed(n.kids)
    text = _html.unescape("".join(out))
    return re.sub(r"\n[ \t]+", "\n", text)


def structured(nodes: list[Node]) -> str:
    """Clean text of subtrees: headings as ``#`` lines, list entries as ``-`` or
    numbered lines, indented by level, table rows with `` | ``, code fenced or in
    backticks, formulas in dollars, everything else plain."""
    out: list[str] = []

    def entries(n: Node, level: int) -> None:
        number = 0
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            if k.tag in ("ul", "ol"):
                entries(k, level + 1)
            elif k.tag == "li":
                number += 1
                own = Node("li", None, kids=[x for x in k.kids if isinstance(x, str) or x.tag not in ("ul", "ol", "pre", "table")])
                mark = f"{number}." if n.tag == "ol" else "-"
                out.append(f"\n{_INDENT * level}{mark} {clean_markdown(text_of(own).strip())}")
                for x in k.kids:
                    if isinstance(x, Node) and x.tag in ("ul", "ol"):
                        entries(x, level + 1)
                    elif isinstance(x, Node) and x.tag in ("pre", "table"):
                        go(x)
            else:
                go(k)

    def go(n: Node) -> None:
        t = n.tag
        if t == "pre":
            code = text_of(n, True).strip("\n")
            mark = "```" if "```" not in code else "~~~~"
            out.append(f"\n\n{mark}\n{code.replace(chr(10), _CODE_END)}\n{mark}\n\n")
        elif len(t) == 2 and t[0] == "h" and t[1].isdigit():
            out.append(f"\n\n{'#' * int(t[1])} {text_of(n).strip()}\n\n")
        elif t in ("ul", "ol"):
            entries(n, 0)
            out.append("\n\n")
        elif t == "li":
            entries(Node("ul", None, kids=[n]), 0)
        elif t == "tr":
            out.append("\n" + " | ".join(text_of(k).strip() for k in n.kids if isinstance(k, Node)))
        elif t in _INLINE_FORMS:
            out.append(_inline(n))
        else:
            for k in n.kids:
                if isinstance(k, str):
                    out.append(re.sub(r"\s+", " ", _html.unescape(k)))
                else:
                    go(k)
            if t in _BLOCK:
                out.append("\n\n" if t not in ("br",) else "\n")

    for node in nodes:
        go(node)
    text = "".join(out)
    text = re.sub(r"\n[ \t]+(?![ \t]|(?:-|\d+\.) )", "\n", re.sub(r"[ \t]+\n", "\n", text))
    text = clean_markdown(re.sub(r"\n{3,}", "\n\n", text).strip("\n "))
    return text.replace(_CODE_END, "\n")


_INDENT, _CODE_END = "  ", "\ue000"  # a private character stands for line ends of code until the text is cleaned


# ---- clean text -----------------------------------------------------------

_WIKI_LINK = re.compile(r"\[\[(?:(?:File|Image|Category|Datei|Fichier|Archivo):[^\]\n]*|(?:[^|\]\n]*\|)?([^|\]\n]+))\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_HEADING = re.compile(r"^(={2,6})\s*([^=\n]+?)\s*\1\s*$", re.M)
_TEX_ENV = re.compile(r"^\s*\\(?:begin|end)\{[^}]*\}\s*$", re.M)
_TEX_SECTION = re.compile(r"^\s*\\(sub)*section\*?\{([^}\n]*)\}", re.M)
_TEX_WRAP = re.compile(r"\\(?:textbf|textit|emph|texttt|underline)\{([^{}\n]*)\}")
_TEX_REF = re.compile(r"~?\\(?:ref|cite|label|eqref)\{[^}\n]*\}")
_EMPHASIS = re.compile(r"(?<![\w*])(\*\*|\*|__)(?=\S)([^*\n]{1,1000}?)(?<=\S)\1(?![\w*])")


def _clean_piece(s: str) -> str:
    if "<" in s:
        s = drop_comments(s)
        s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
        s = re.sub(r"</t[dh]>\s*<t[dh][^>]*>", " | ", s, flags=re.I)
        s = re.sub(r"<li[^>]*>", "\n- ", s, flags=re.I)
        s = re.sub(r"</(?:p|div|tr|h[1-6]|ul|ol|table)>", "\n", s, flags=re.I)
        s = HTML_TAG.sub("", s)
    if "&" in s:
        s = _html.unescape(s).replace("\u00a0", " ")
    if "{{" in s:
        s = _WIKI_TEMPLATE.sub("", s)
    if "[[" in s:
        s = _WIKI_LINK.sub(lambda m: m.group(1) or "", s)
    if "==" in s:
        s = _WIKI_HEADING.sub(lambda m: "#" * len(m.group(1)) + " " + m.group(2), s)
    if "''" in s:
        s = re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", s)
    if "{|" in s or "|}" in s or "|-" in s:
        s = re.sub(r"^\{\|[^\n]*$|^\|\}\s*$|^\|-\s*$", "", s, flags=re.M)
        s = re.sub(r"^[!|] ?(.*(?:\|\||!!).*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)), s, flags=re.M)
    if "\\" in s:
        s = _TEX_ENV.sub("", s)
        s = _TEX_SECTION.sub(lambda m: "## " + m.group(2), s)
        s = re.sub(r"^\s*\\item\s+", "- ", s, flags=re.M)
        s = _TEX_REF.sub("", _TEX_WRAP.sub(r"\1", s))
        s = re.sub(r"\\([%&#_$])", r"\1", s)
    if "](" in s:
        s = replace_links(s, find_links(s))
    if "*" in s or "__" in s:
        s = _EMPHASIS.sub(r"\2", s)
    return s


def clean_markdown(text: str) -> str:
    """Markdown with foreign markup to clean text; fenced code, inline code and
    formulas stay as they are."""
    out, pos = [], 0
    for m in _FENCE.finditer(text):
        out += [_clean_around_code(text[pos : m.start()]), m.group(0)]
        pos = m.end()
    out.append(_clean_around_code(text[pos:]))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip("\n ")


def _clean_around_code(s: str) -> str:
    """Inline code waits behind a private character while its line is cleaned."""
    if "`" not in s:
        return _clean_piece(s)
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group(0))
        return "\ue001"

    s = _INLINE.sub(hold, s.replace("\ue001", ""))
    parts = iter(held)
    return re.sub("\ue001", lambda _: next(parts, ""), _clean_piece(s))


def html_findings(source: str) -> tuple[list[str], list[Node]]:
    """(kinds of markup the content subtrees show, the subtrees)."""
    body = parse(source)
    measure(body)
    nodes = content_nodes(body)
    text = "\n".join(visible(n) for n in nodes)
    found = ["markdown"] if MARKDOWN.search(text) or any(x[2] and x[3] for x in find_links(text)) else []
    return leftovers(without_code(text)) + found, nodes


SCHEMA = "page_id BIGINT, field STRING, text STRING, markup ARRAY<STRING>"


def clean_documents(df: DataFrame, id_col: str, markdown_col: str, html_col: str, status_col: str | None = None, residue: Residue | None = None, with_text: bool = True) -> DataFrame:
    """One row per non-empty field with its clean text and the markup it shows.
    Records whose Markdown is residue or junk show none."""
    held = df.sparkSession.sparkContext.broadcast(residue or fit_residue(df, id_col, markdown_col, status_col))

    def run(b: dict[str, list]) -> dict[str, list]:
        model = held.value
        out: dict[str, list] = {"page_id": [], "field": [], "text": [], "markup": []}

        def add(i: int, name: str, text: str | None, marks: list[str]) -> None:
            out["page_id"].append(i)
            out["field"].append(name)
            out["text"].append(text)
            out["markup"].append(marks)

        for i, md, source in zip(b["i"], b["m"], b["h"], strict=True):
            md_marks = leftovers(without_code(md)) if md else []
            html_marks, nodes = [], []
            if source:
                html_marks, nodes = html_findings(source)
            if (md_marks or html_marks) and md:
                p = profile(md)
                if quality_kind(p)[0] == "junk" or model.kind(p):
                    md_marks = html_marks = []
            elif html_marks:  # no Markdown to judge by: the visible text stands in
                p = profile("\n".join(map(visible, nodes)))
                if quality_kind(p)[0] == "junk" or model.kind(p):
                    html_marks = []
            if md:
                add(i, "markdown", clean_markdown(md) if with_text else None, md_marks)
            if source:
                add(i, "html", structured(nodes) if with_text else None, html_marks)
        return out

    return map_rows(spread(pick(df, i=id_col, m=markdown_col, h=html_col)), run, SCHEMA)
