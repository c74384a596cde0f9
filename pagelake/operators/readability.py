"""The article of a page, by scores of its paragraphs.

Each paragraph gives points for its length and its commas to the elements above
it, less with each level; the names of classes and ids add or take some, links
take their share.  The best element and those beside it that score or read like
it are the article.  Pure Python, one walk over the tree.
"""

from __future__ import annotations

import re

from .htmltree import Element

_LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
_UNLIKELY = re.compile(r"banner|breadcrumb|combx|comment|community|cookie|disqus|extra|foot|header|legend|menu|modal|nav|pager|popup|promo|related|remark|rss|share|sidebar|skyscraper|social|sponsor|subscribe|tags|widget", re.I)
_UNREAD = frozenset(("script", "style", "noscript", "template", "svg", "form", "button", "select", "textarea"))
_OUTSIDE = frozenset(("nav", "aside", "footer", "header", "form"))
_SCORED = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
_START = {"article": 10.0, "section": 3.0, "div": 5.0, "main": 8.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0, "h1": -5.0, "h2": -5.0}
LEAST_CHARS = 25
LEVELS = 3  # elements above a paragraph that get points


def _weight(e: Element) -> float:
    names = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
    return 25.0 * bool(_LIKELY.search(names)) - 25.0 * bool(_UNLIKELY.search(names))


def _text(e: Element) -> str:
    return " ".join(e.text(_UNREAD).split())


def _link_share(e: Element, size: int) -> float:
    return min(1.0, sum(len(_text(a)) for a in e.walk() if a.tag == "a") / size) if size else 0.0


def _points(text: str) -> float:
    return 1.0 + sum(text.count(c) for c in ",、，") + min(len(text) / 100, 3.0)


def article(root: Element) -> list[Element]:
    """The elements of the article in their order; empty for a page without a
    paragraph of ``LEAST_CHARS``."""
    scores: dict[int, tuple[float, Element]] = {}
    for e in root.walk():
        if e.tag not in _SCORED and not (e.tag == "div" and all(isinstance(c, str) or c.tag in ("a", "b", "i", "em", "strong", "span", "br", "code") for c in e.children)):
            continue
        text = _text(e)
        if len(text) < LEAST_CHARS:
            continue
        points, up, level = _points(text), e.parent, 1
        while up is not None and up.tag not in ("html", "#root") and level <= LEVELS:
            held = scores.get(id(up))
            start = held[0] if held else _START.get(up.tag, 0.0) + _weight(up) - 50.0 * (up.tag in _OUTSIDE)
            scores[id(up)] = (start + points / (1, 2, 6)[level - 1], up)
            up, level = up.parent, level + 1
    rated = [(s * (1.0 - _link_share(e, len(_text(e)))), e) for s, e in scores.values()]
    if not rated:
        return []
    top, best = max(rated, key=lambda x: x[0])
    if best.parent is None:
        return [best]
    by_id = {id(e): s for s, e in rated}
    out = []
    for x in best.parent.elements():
        if x is best or by_id.get(id(x), 0.0) >= max(10.0, 0.2 * top):
            out.append(x)
        elif x.tag == "p":
            t = _text(x)
            links = _link_share(x, len(t))
            if len(t) > 80 and links < 0.25 or 0 < len(t) <= 80 and not links and t[-1] in ".!?。":
                out.append(x)
    return out
