"""Statistics of a record's main body, from which problems 4, 5 and 7 decide.

``profile(markdown)`` runs the block rules once and measures what the main
body consists of: sentences, list entries, cells and numbers, links, or
characters that form no words.  Pure Python, no Spark.
"""

from __future__ import annotations

import re
from collections import namedtuple
from dataclasses import dataclass, field

from .lexicon import ALL_STOP
from .lines import H1, HEAD, LINKS, PROSE, SOLID, find_links, main_body, replace_links, stop_density

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ITEM = re.compile(r"^(?:[-*+]|\d{1,3}[.)])\s+")
_NUMERIC = re.compile(r"^[\d.,;:|/%\s+-]+$")
_VOWEL = re.compile(r"[aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüýąęœ]", re.I)
_LATIN = re.compile(r"[a-zß-ɏ]", re.I)
_CASE = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]")
_END = re.compile(r"[.!?。！？…][\"'”’»)*_]*\s*$")
_SENTENCE = re.compile(r"[^.!?。！？]{12,}[.!?。！？]+")
_URL = re.compile(r"<?https?://\S+")
_COUNT = re.compile(r"^x?\d+(?:[.,:]\d+)*[a-z%]{0,2}$")
_JOIN = str.maketrans("", "", "'’-.、。・，,")
_EDGE = "\"'“”‘’«»„()[]{}.,;:!?*_#`…–—-+<>/|\\~=&^%@"


@dataclass
class Profile:
    lines: list[str] = field(default_factory=list)  # text lines of the main body, heading included
    kinds: list[int] = field(default_factory=list)
    heads: int = 0
    prose: int = 0  # lines
    sentences: int = 0
    prose_chars: int = 0
    items: int = 0
    item_chars: int = 0
    cells: int = 0
    cell_chars: int = 0
    links: int = 0
    link_chars: int = 0
    other: int = 0
    other_chars: int = 0
    code: int = 0
    chars: int = 0
    n_links: int = 0
    plain_words: int = 0  # words outside links, headings and URLs
    wordlike: float = 1.0  # share of the characters of tokens that are words
    text: str = ""  # body without headings, link targets and URLs

    @property
    def rows(self) -> int:
        return self.prose + self.items + self.cells + self.links + self.other


def _wordlike(tokens: list[str]) -> float:
    good = total = 0
    for t in tokens:
        w = t.strip(_EDGE)
        n = len(t)
        if not w:
            total += n
            continue
        if w.isdigit() or _COUNT.match(w):
            continue
        total += n
        if len(w) > 30 and _LATIN.search(w):
            continue
        core = w.translate(_JOIN)
        if core.isalpha() and not _CASE.search(w):
            if not _LATIN.search(w) or _VOWEL.search(w) and (len(w) > 2 or w.lower() in ALL_STOP or not w.isascii()) or w.lower() in ALL_STOP:
                good += n
            elif w.isupper() and 1 < len(w) <= 5:
                good += n
        elif "://" in t or "@" in w[1:-1]:
            good += n
        elif "=" in w and w.isascii() and len(w) < 30:
            good += n
    return good / total if total else 1.0


def profile(markdown: str) -> Profile:
    lines, kinds, flags = main_body(markdown)
    p = Profile()
    plain: list[str] = []
    fence = False
    for line, k, f in zip(lines, kinds, flags, strict=True):
        if not f:
            continue
        s = line.strip()
        if not s:
            continue
        p.lines.append(s)
        p.kinds.append(k)
        if k == SOLID and s[:3] in ("```", "~~~"):
            fence = not fence
            continue
        if fence:
            p.code += 1
            continue
        if k == H1 or k == HEAD:
            p.heads += 1
            continue
        n = len(s)
        if "](" in s or "://" in s:
            found = find_links(s)
            rest = replace_links(s, found, " ")
            urls = _URL.findall(rest)
            rest = _URL.sub(" ", rest)
            visible = sum(len(x[2]) for x in found)
            words_left = len(WORD.findall(rest))
            p.n_links += len(found) + len(urls)
            if k == LINKS or found and s[0] != "!" and words_left <= 3 * (len(found) + len(urls)) and not _END.search(rest.strip()):
                p.links += 1
                p.link_chars += visible + len(rest) + 12 * len(urls)
                continue
            s = replace_links(s, found)
            s = _URL.sub(" ", s)
            n = len(s)
        plain.append(s)
        if k == PROSE and _END.search(s) and not _ITEM.match(s):
            p.prose += 1
            p.prose_chars += n
            p.sentences += max(1, len(_SENTENCE.findall(s)))
        elif s[0] == "|" or "\t" in s or _NUMERIC.match(s):
            p.cells += 1
            p.cell_chars += n
        elif _ITEM.match(s):
            if (k == PROSE or n >= 30) and _END.search(s):
                p.prose += 1
                p.prose_chars += n
                p.sentences += 1
            else:
                p.items += 1
                p.item_chars += n
        else:
            p.other += 1
            p.other_chars += n
            if _END.search(s) and stop_density(s) >= 0.1:
                p.sentences += max(1, len(_SENTENCE.findall(s)))
    p.chars = p.prose_chars + p.item_chars + p.cell_chars + p.link_chars + p.other_chars
    p.text = "\n".join(plain)
    tokens = p.text.split()
    p.plain_words = len(tokens)
    if p.sentences * 2 < p.rows or p.prose_chars * 2 < p.chars:
        p.wordlike = _wordlike(tokens)
    return p


_ENTRY = re.compile(r"^[^.!?。]{1,48}?(?: \(\d+\)| ?x ?\d+|, \d+ ?\w{1,3})+$")


MEASURES = ("rows", "prose", "sentences", "prose_chars", "entries", "items", "cells", "links", "chars", "words", "size", "word_share")


def measures(p: Profile) -> tuple[float, ...]:
    """What the quality rules read of a body, in the order of MEASURES: lines by
    kind, characters, words, and the share of its characters in words."""
    entries = p.items
    if p.other >= 3:
        short = marked = width = 0
        for s, k in zip(p.lines, p.kinds, strict=True):
            if k not in (H1, HEAD, PROSE, SOLID) and s[0] != "|" and "\t" not in s and len(s) <= 64 and not _ITEM.match(s) and not _END.search(s):
                short += 1
                width += len(s.split())
                marked += bool(_ENTRY.match(s))
        if marked >= 0.3 * short or short >= 8 and width <= 5 * short:  # entries without a bullet, told by their counts and measures
            entries += short
    return (p.rows, p.prose, p.sentences, p.prose_chars, entries, p.items, p.cells, p.links, p.chars, p.plain_words, len(p.text), p.wordlike)


def _few(m) -> bool:
    return (m.prose <= 1) & (m.sentences <= 2) | (m.prose_chars <= 0.25 * m.chars)


# Fixed thresholds in the manner of the published symbol, bullet and word rules
# for web text: (kind, reason, fails).  ``m`` holds MEASURES, as numbers or arrays.
QUALITY_RULES = (
    (
        "junk", "word_share<0.55",
        lambda m: (m.rows > 0) & (m.cells < m.rows / 2) & ((m.words >= 4) | (m.size >= 60)) & (m.links < m.rows / 2) & (m.word_share < 0.55) & ((m.items < m.rows / 2) | (m.word_share < 0.35)),
    ),
    ("table", "cell_line_share>=0.6", lambda m: _few(m) & (m.cells >= 3) & (m.cells >= 0.6 * m.rows) & (m.prose_chars <= 0.45 * m.chars)),
    ("list", "bullet_line_share>=0.6", lambda m: _few(m) & (m.entries >= 6) & (m.entries >= 0.6 * m.rows) & (m.chars > m.prose_chars) & (m.prose_chars <= 0.55 * m.chars)),
)
Measures = namedtuple("Measures", MEASURES)


def quality_kind(p: Profile) -> tuple[str | None, str | None]:
    """(kind, reason) of the first rule of QUALITY_RULES that a body fails."""
    if p.rows:
        m = Measures(*measures(p))
        for kind, reason, fails in QUALITY_RULES:
            if fails(m):
                return kind, reason
    return None, None
