"""Block rules that split a page into main body and boilerplate, line by line.

Two passes.  Pass one classifies every line on its own from stop-word density,
length and link density; cue words add what these can't tell, mostly bylines,
dates and prompts in the middle of a body.  Pass two lets the ambiguous lines
take a label from those around them: behind the last strong paragraph (several
sentences, or one of ``STRONG_CHARS``) link lines, headings that lead to no text,
short lines and single sentences after them are boilerplate; elsewhere list
items, link lines, small headings and labels follow the nearest decided
neighbour.  The same engine serves Markdown and HTML: both are reduced
to the visible text of a line plus a few flags.  Pure Python, no Spark.
"""

from __future__ import annotations

import html as _html
import re

from .lexicon import ALL_STOP, BYLINE_RE, CUE_RE, NAV_LABELS, RELATED_RE

BLANK, PROSE, CUE, RELATED, NAV, LINKS, H1, HEAD, SHORT, SOLID, LABEL, ITEM, BREAK, WEAK = range(14)
STRONG_CHARS = 160
SHORT_CHARS = 80
GOOD_ANCHORS = frozenset((PROSE, WEAK, H1, SOLID))
BAD_ANCHORS = frozenset((RELATED, NAV))
CACHE_ROWS = 200_000

_TARGET_END = re.compile(r"[)\s]")
_LIST = re.compile(r"^(?:[-*+]|\d{1,3}[.)])\s+")
_HEADING = re.compile(r"^(#{1,6})(?:\s+|$)")
_WS = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_HIRA = re.compile(r"[ぁ-ゟ]")
_CJK = re.compile(r"[ぁ-ヿ一-鿿]")
_TAG = re.compile(r"<[^<>]*>")
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_HIDDEN_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_A_OPEN = re.compile(r"<a\b[^<>]*>", re.I)
_A_CLOSE = re.compile(r"</a\s*>", re.I)
_URLLINE = re.compile(r"^<?https?://\S+>?$")
_SENTENCE = re.compile(r"[.!?](?:[\"'”’»)*_]*\s|[\"'”’»)*_]*$)|[。！？]")
_SEP = re.compile(r"\s*[|·•/]\s*")
_EMPH = "*_ \t"
_MARKUP = tuple("{}|[\\=!<>»`#$-")


def find_links(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, label, target) of the Markdown links and images of a text,
    of any length, in linear time."""
    out: list[tuple[int, int, str, str]] = []
    low = stop = 0  # no label begins before low; no target that begins before stop ends before it
    at = text.find("](")
    while at >= 0:
        low = max(low, text.rfind("]", low, at) + 1, text.rfind("\n", low, at) + 1)
        begin = text.find("[", low, at)
        if begin >= 0:
            if stop < at + 2:
                m = _TARGET_END.search(text, at + 2)
                stop = m.start() if m else len(text)
            if text[stop : stop + 1] == ")":
                start = begin - (begin > (out[-1][1] if out else 0) and text[begin - 1] == "!")
                out.append((start, stop + 1, text[begin + 1 : at], text[at + 2 : stop]))
                low = stop + 1
                at = text.find("](", low)
                continue
        low = at + 1
        at = text.find("](", at + 1)
    return out


def replace_links(text: str, links: list[tuple[int, int, str, str]], by: str | None = None) -> str:
    """The text with its links replaced, by their labels if ``by`` is None."""
    out, pos = [], 0
    for start, end, label, _ in links:
        out += [text[pos:start], label if by is None else by]
        pos = end
    out.append(text[pos:])
    return "".join(out)


def anchors(line: str) -> list[str]:
    """What the ``a`` elements of a line hold."""
    out: list[str] = []
    pos = 0
    while (m := _A_OPEN.search(line, pos)) and (e := _A_CLOSE.search(line, m.end())):
        out.append(line[m.end() : e.start()])
        pos = e.end()
    return out


def stop_density(text: str) -> float:
    """Share of function words; of hiragana characters for Japanese text."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    cjk = len(_CJK.findall(text))
    if cjk > 0.3 * len(text):
        return len(_HIRA.findall(text)) / max(1, cjk)
    return sum(w in ALL_STOP for w in words) / len(words)


def _kind(text: str, link_chars: int, n_links: int, level: int, item: bool, quote: bool) -> int:
    """Pass one.  ``text``: visible text, markup removed, spaces collapsed."""
    core = text.strip(_EMPH)
    low = core.lower()
    if level == 1:
        return H1 if not (CUE_RE.search(low) and len(core) < 40 or RELATED_RE.match(low)) else CUE
    if level and RELATED_RE.match(low) or (not item and not quote and len(core) < 60 and RELATED_RE.match(low) and link_chars == 0):
        return RELATED
    if not quote and len(core) <= 200 and CUE_RE.search(low):
        return CUE
    if not item and not quote and len(core) <= 60 and BYLINE_RE.match(core):
        names = core.split()[1:]
        if all(n[0].isupper() for n in names) or core == low or core[0] in "文著":
            return CUE
    if low in NAV_LABELS:
        return LABEL
    if not quote and (" > " in core or " › " in core or " » " in core) and len(core) < 160 and core[-1] not in ".!?":
        head = re.split(r" [>›»] ", low, maxsplit=1)[0].strip()
        if head in NAV_LABELS or len(re.split(r" [>›»] ", low)) > 2:
            return NAV
    if not item and ("|" in core or "·" in core) and len(core) < 400:
        parts = [p.strip() for p in _SEP.split(low) if p.strip()]
        if len(parts) > 1 and sum(p in NAV_LABELS for p in parts) * 2 > len(parts):
            return NAV
    if level:
        return HEAD
    density = link_chars / max(1, len(core))
    if n_links and density > 0.8 or _URLLINE.match(core):
        return LINKS
    if item:
        return PROSE if len(core) > 60 and stop_density(core) > 0.2 else ITEM
    if len(core) >= 40 and density < 0.5 and stop_density(core) >= 0.15:
        return PROSE if quote or item or len(core) >= STRONG_CHARS or len(_SENTENCE.findall(core)) > 1 else WEAK
    if quote or len(core) > SHORT_CHARS or core[:1] in _MARKUP or sum(map(core.count, ",;、")) > 2 and stop_density(core) < 0.1:
        return ITEM  # quotations, enumerations, long runs of words and lines of other markup belong to what stands around them
    return SHORT


_md_cache: dict[str, int] = {}


def markdown_kind(line: str) -> int:
    """Kind of one Markdown line outside fenced code."""
    k = _md_cache.get(line)
    if k is None:
        s = line.strip()
        if not s:
            return BLANK
        level = 0
        quote = False
        if s[0] == "#" and (m := _HEADING.match(s)):
            level = len(m.group(1))
            s = s[m.end() :].strip()
        elif s[0] == ">":
            quote = True
            s = s.lstrip("> ").strip()
        item = False
        if not level and (m := _LIST.match(s)):
            item, s = True, s[m.end() :]
        if s[:1] == "|" or s[:2] in ("$$", "![") or s[:4] in ("\\beg", "\\end"):
            k = SOLID if not s.startswith("| |") else SHORT
        else:
            link_chars = n = 0
            if "](" in s:
                found = find_links(s)
                n = len(found)
                link_chars = sum(len(x[2]) for x in found)
                s = replace_links(s, found)
            k = _kind(" ".join(s.split()), link_chars, n, level, item, quote) if s.strip() else SHORT
        if len(_md_cache) > CACHE_ROWS:
            _md_cache.clear()
        _md_cache[line] = k
    return k


def markdown_kinds(text: str) -> tuple[list[str], list[int]]:
    """Lines (split at \\n only) and their pass-one kinds."""
    lines = text.split("\n")
    kinds: list[int] = []
    fence = ""
    for line in lines:
        s = line.lstrip()
        if fence:
            kinds.append(SOLID)
            if s.startswith(fence):
                fence = ""
        elif s.startswith(("```", "~~~")):
            fence = s[:3]
            kinds.append(SOLID)
        else:
            kinds.append(markdown_kind(line))
    if fence:  # an unclosed fence is no code
        kinds = [markdown_kind(x) if x.lstrip()[:3] not in ("```", "~~~") else SOLID for x in lines]
    return lines, kinds


_html_cache: dict[str, int] = {}
_HEAD_TAG = re.compile(r"<h([1-6])\b", re.I)


def html_kind(line: str) -> int:
    """Kind of one HTML line that holds visible text (tags still in it)."""
    k = _html_cache.get(line)
    if k is None:
        low = line.lower()
        m = _HEAD_TAG.search(low)
        text = _WS.sub(" ", _html.unescape(_TAG.sub("", line))).strip()
        links = anchors(line)
        link_chars = sum(len(_html.unescape(_TAG.sub("", a))) for a in links)
        k = (
            SOLID
            if "<td" in low or "<th" in low or "<img" in low
            else _kind(text, link_chars, len(links), int(m.group(1)) if m else 0, "<li" in low, "<blockquote" in low)
        )
        if len(_html_cache) > CACHE_ROWS:
            _html_cache.clear()
        _html_cache[line] = k
    return k


def without_hidden(text: str) -> str:
    """HTML without comments, scripts and styles; their line ends stay.  One
    pass: an unclosed one stays as it is, and ends the search for its kind."""
    out: list[str] = []
    pos = at = 0
    dead: set[str] = set()
    while m := _HIDDEN.search(text, at):
        at = m.end()
        kind = (m.group(1) or "").lower()
        if kind in dead:
            continue
        end = _HIDDEN_END[kind].search(text, at)
        if end is None:
            dead.add(kind)
            continue
        out += [text[pos : m.start()], "\n" * text.count("\n", m.start(), end.end())]
        pos = at = end.end()
    out.append(text[pos:])
    return "".join(out)


_BODY = re.compile(r"<body\b[^>]*>", re.I)
_BODY_END = re.compile(r"</body\s*>", re.I)
_OPEN_TAG = re.compile(r"<[^<>\n]*\n[^<>]*>")
_ENDS_LIST = ("</ul", "</ol", "</table", "</tr></table")


def html_kinds(text: str) -> tuple[list[str], list[int]]:
    """Lines of the whole source and kinds; lines outside the body element or
    without visible text are BLANK (list ends are BREAK)."""
    text = without_hidden(text)
    m = _BODY.search(text)
    start = m.end() if m else 0
    e = _BODY_END.search(text, start)
    stop = e.start() if e else len(text)
    offset = text.count("\n", 0, start)
    total = text.count("\n") + 1
    body = text[start:stop]
    if _OPEN_TAG.search(body):  # a tag over several lines shows no text on any
        body = _OPEN_TAG.sub(lambda t: re.sub(r"[^\n]+", "", t.group(0)), body)
    lines = body.split("\n")
    kinds = [BLANK] * offset
    pre = False
    for line in lines:
        s = line.strip()
        if not s:
            kinds.append(BLANK)
            continue
        has_pre = "<pre" in s
        visible = s[0] != "<" or bool(_TAG.sub("", s).strip())
        if pre or has_pre:
            kinds.append(SOLID if visible else BLANK)
            pre = (pre or has_pre) and "</pre" not in s
        elif not visible:
            kinds.append(BREAK if s.lower().startswith(_ENDS_LIST) else BLANK)
        else:
            kinds.append(html_kind(s))
    kinds += [BLANK] * (total - len(kinds))
    return lines, kinds


_LISTY = frozenset((LINKS, LABEL, ITEM))


def _tail(kinds: list[int]) -> set[int]:
    """Boilerplate behind the last strong paragraph."""
    strong = sum(k == PROSE for k in kinds)
    if not strong:
        return set()
    last = max(i for i, k in enumerate(kinds) if k in (PROSE, SOLID, ITEM))
    rest = [i for i in range(last + 1, len(kinds)) if kinds[i] not in (BLANK, BREAK)]
    short = sum(kinds[i] == SHORT for i in rest)
    room = short <= 2 * strong  # a body of short lines has few strong ones,
    some = sum(kinds[i] in (LINKS, SHORT, ITEM) for i in rest) <= 6 * strong  # and so has a body of links
    out: set[int] = set()
    left = False  # behind a line that leads away
    for at, i in enumerate(rest):
        k = kinds[i]
        left = left or k in _LINKY and k != CUE
        after = kinds[rest[at + 1]] if at + 1 < len(rest) else BLANK
        if k == LINKS and not some:
            continue
        if k in _LINKY or k == HEAD and after in (LINKS, SHORT, LABEL, CUE, WEAK) or k == SHORT and room or k == WEAK and left:
            out.add(i)
    return out


_LINKY = frozenset((LINKS, NAV, LABEL, CUE, RELATED))


def main_flags(kinds: list[int]) -> list[bool | None]:
    """Pass two.  True: main body, False: boilerplate, None: no text."""
    n = len(kinds)
    out: list[bool | None] = [None] * n
    first_h1 = -1
    for i, k in enumerate(kinds):
        if k == H1:
            first_h1 = i
            break
    if first_h1 >= 0 and sum(k == PROSE or k == WEAK for k in kinds[:first_h1]) >= 3:
        first_h1 = -1
    tail = _tail(kinds)
    anchor: list[int] = [0] * n  # 1 good, -1 bad, 0 undecided
    related = 0  # 1 after a related heading, 2 inside its list
    for i, k in enumerate(kinds):
        if k == BLANK or k == BREAK:
            if related == 2:
                related = 0
            continue
        if i < first_h1 or i in tail:
            out[i] = False
            if i < first_h1 or k in (LINKS, NAV, RELATED):
                anchor[i] = -1
            continue
        if related:
            if k in _LISTY:
                related = 2
                out[i], anchor[i] = False, -1
                continue
            related = 0
        if k == RELATED:
            related = 1
            out[i], anchor[i] = False, -1
        elif k == CUE:
            out[i] = False
        elif k == NAV:
            out[i], anchor[i] = False, -1
        elif k == LABEL:
            out[i] = False
        elif k in GOOD_ANCHORS:
            out[i], anchor[i] = True, 1
    # nearest decided neighbour, distance in lines with text
    todo = [i for i in range(n) if out[i] is None and kinds[i] not in (BLANK, BREAK)]
    if not todo:
        return out
    if 1 not in anchor:  # nothing decided as good: short text is all there is
        for i in todo:
            out[i] = kinds[i] != LINKS or -1 not in anchor
        return out
    before: list[tuple[int, int]] = []
    seen, last, label = 0, -(10**6), 0
    for i in range(n):
        if kinds[i] not in (BLANK, BREAK):
            seen += 1
        before.append((seen - last if label else 10**6, label))
        if anchor[i]:
            last, label = seen, anchor[i]
    pending = set(todo)
    seen, last, label = 0, 0, 0
    for i in range(n - 1, -1, -1):
        if kinds[i] not in (BLANK, BREAK):
            seen += 1
        if i in pending:
            d1, l1 = before[i]
            d2, l2 = (seen - last, label) if label else (10**6, 0)
            if first_h1 >= 0 and l1 == 1 or l1 == l2:
                out[i] = (l1 or l2) > 0
            elif l2 == 1 and kinds[i] in (SHORT, HEAD):  # a title or short line that leads to the body
                out[i] = True
            elif d1 == d2:
                out[i] = True
            else:
                out[i] = (l1 if d1 < d2 else l2) > 0
        if anchor[i]:
            last, label = seen, anchor[i]
    return out


def main_body(markdown: str) -> tuple[list[str], list[int], list[bool | None]]:
    lines, kinds = markdown_kinds(markdown)
    return lines, [PROSE if k == WEAK else k for k in kinds], main_flags(kinds)
