"""A small lenient HTML tree and a CSS selector subset, without dependencies.

Implied end tags for p, li, dt, dd, tr, td, th and option; void and raw-text
elements; unclosed elements end with their parent.  Selectors: tag, #id, .class,
[a], [a=v] with = *= ^= $= ~= |=, :first-child, :not(simple), descendant and
child combinators, comma lists.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "p": BLOCK - {"html", "body"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
_STOP_AT = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


MAX_DEPTH = 200  # deeper elements become siblings, so that no page is too deep to walk


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list[Element | str] = []
        self.parent = parent
        self.depth = 0 if parent is None else parent.depth + 1

    def walk(self) -> Iterator[Element]:
        """This element and all below, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                stack.extend(reversed(x.children))
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def select(self, selector: str) -> list[Element]:
        return select(self, selector)

    def outer(self) -> str:
        """Serialised again."""
        if self.tag == "#root":
            return "".join(c if isinstance(c, str) else c.outer() for c in self.children)
        attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        raw = self.tag in ("script", "style")
        inner = "".join((c if raw else _html.escape(c, quote=False)) if isinstance(c, str) else c.outer() for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), _html.unescape(a or b or c))
    return out


def parse(source: str) -> Element:
    root = Element("#root")
    at, pos, n = root, 0, len(source)
    while pos < n:
        m = _TAG.search(source, pos)
        if m is None:
            at.children.append(_html.unescape(source[pos:]))
            break
        if m.start() > pos:
            at.children.append(_html.unescape(source[pos : m.start()]))
        pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            up = at
            while up is not root and up.tag != name:
                if up.tag == "table" and name not in ("table", "div", "body", "html"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        while at is not root and name in _CLOSES.get(at.tag, ()):  # implied end tags
            at = at.parent
        if name in _STOP_AT:  # an item inside inline elements of the last item
            up = at
            while up is not root and up.tag not in _STOP_AT[name]:
                if name in _CLOSES.get(up.tag, ()):
                    at = up.parent
                    break
                up = up.parent
        raw_attrs = m.group(3)
        e = Element(name, _attributes(raw_attrs) if raw_attrs.strip() else {}, at)
        at.children.append(e)
        if name in VOID or raw_attrs.endswith("/") and name not in ("a", "div", "p", "span"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, pos)
            stop = end.start() if end else n
            inner = source[pos:stop]
            e.children.append(inner if name in ("script", "style") else _html.unescape(inner))
            pos = end.end() if end else n
        elif e.depth < MAX_DEPTH:
            at = e
    return root


# ---- selectors --------------------------------------------------------------------

_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<flag>i)?\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child)|:not\((?P<neg>[^()]+)\)"
)
_compiled: dict[str, list[list[tuple[str, list[dict]]]]] = {}


class SelectorError(ValueError):
    pass


def _compound(text: str) -> list[dict]:
    out, pos = [], 0
    while pos < len(text):
        m = _SIMPLE.match(text, pos)
        if not m or m.end() == pos:
            raise SelectorError(f"not a selector: {text!r}")
        d = {k: v for k, v in m.groupdict().items() if v is not None}
        if "neg" in d:
            d["neg"] = _compound(d["neg"].strip())
        out.append(d)
        pos = m.end()
    if not out:
        raise SelectorError("empty selector")
    return out


def _split(text: str, sep: str) -> list[str]:
    """Splits outside brackets, parentheses and quotes."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == sep and not depth:
            parts.append(text[last:i])
            last = i + 1
    parts.append(text[last:])
    return parts


def compile_selector(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives of chains of (combinator, compound)."""
    got = _compiled.get(selector)
    if got is None:
        got = []
        for alt in _split(selector, ","):
            s = re.sub(r"\s*>\s*", " > ", alt.strip())
            chain, comb = [], " "
            for token in [t for t in _split(s, " ") if t]:
                if token == ">":
                    comb = ">"
                else:
                    chain.append((comb, _compound(token)))
                    comb = " "
            if not chain:
                raise SelectorError(f"not a selector: {selector!r}")
            got.append(chain)
        _compiled[selector] = got
    return got


def _matches(e: Element, compound: list[dict]) -> bool:
    for d in compound:
        if "tag" in d:
            if d["tag"] != "*" and e.tag != d["tag"].lower():
                return False
        elif "id" in d:
            if e.attrs.get("id") != d["id"]:
                return False
        elif "cls" in d:
            if d["cls"] not in e.classes:
                return False
        elif "attr" in d:
            have = e.attrs.get(d["attr"].lower())
            if have is None:
                return False
            if "op" in d:
                want = d.get("v1", d.get("v2", d.get("v3", "")))
                if d.get("flag"):
                    have, want = have.lower(), want.lower()
                op = d["op"]
                ok = (
                    have == want if op == "=" else bool(want) and want in have if op == "*=" else bool(want) and have.startswith(want) if op == "^="
                    else bool(want) and have.endswith(want) if op == "$=" else want in have.split() if op == "~=" else have == want or have.startswith(want + "-")
                )
                if not ok:
                    return False
        elif "pseudo" in d:
            kin = e.parent.elements() if e.parent else [e]
            if kin[0 if d["pseudo"] == "first-child" else -1] is not e:
                return False
        elif "neg" in d and _matches(e, d["neg"]):
            return False
    return True


def _chain_matches(e: Element, chain: list[tuple[str, list[dict]]]) -> bool:
    if not _matches(e, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    rest, up = chain[:-1], e.parent
    if chain[-1][0] == ">":
        return up is not None and _chain_matches(up, rest)
    while up is not None:
        if _chain_matches(up, rest):
            return True
        up = up.parent
    return False


class _Matcher:
    """A selector list with its plain alternatives (one tag, id or class) as sets."""

    __slots__ = ("tags", "ids", "names", "rest")

    def __init__(self, selector: str):
        self.tags: set[str] = set()
        self.ids: set[str] = set()
        self.names: set[str] = set()
        self.rest: list[list[tuple[str, list[dict]]]] = []
        for chain in compile_selector(selector):
            only = chain[0][1][0] if len(chain) == 1 and len(chain[0][1]) == 1 else {}
            if "tag" in only and only["tag"] != "*":
                self.tags.add(only["tag"].lower())
            elif "id" in only:
                self.ids.add(only["id"])
            elif "cls" in only:
                self.names.add(only["cls"])
            else:
                self.rest.append(chain)

    def __call__(self, e: Element) -> bool:
        if e.tag in self.tags:
            return True
        attrs = e.attrs
        if attrs:
            if self.ids and attrs.get("id") in self.ids:
                return True
            if self.names and "class" in attrs and not self.names.isdisjoint(attrs["class"].split()):
                return True
        return bool(self.rest) and any(_chain_matches(e, c) for c in self.rest)


_matchers: dict[str, _Matcher] = {}


def _matcher(selector: str) -> _Matcher:
    m = _matchers.get(selector)
    if m is None:
        m = _matchers[selector] = _Matcher(selector)
    return m


def matches(e: Element, selector: str) -> bool:
    return _matcher(selector)(e)


def select(root: Element, selector: str) -> list[Element]:
    """All matches below ``root`` in document order."""
    m = _matcher(selector)
    return [e for e in root.walk() if e is not root and m(e)]


def select_first(root: Element, selector: str) -> Element | None:
    m = _matcher(selector)
    return next((e for e in root.walk() if e is not root and m(e)), None)
