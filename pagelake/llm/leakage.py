"""Problem 9: evaluation texts leaking into training text.

Method: Wu-Manber multi-pattern search over words.  Every window of ``WORDS``
consecutive words of a test item is a pattern; blocks are pairs of words.  The
shift table tells how far the search may jump after a block, a hash bucket of
the pattern's last block names the patterns that may end there, and direct
comparison confirms the occurrence.  A text whose words are foreign to the test
items is read at one look every twelve words.

The test items are a stated query set: their words are held once, with a
position for every window, and broadcast; a scan takes items of up to
``WORDS_A_PASS`` words in all (about 150 MB of tables, however long each item
is), further ones a scan of their own.

Null and empty texts give no row; an item found several times in a text gives
one row.  Items of fewer words than the window give none, as the case is defined
by that many words; a text without spaces is one word, so that a Japanese item
has few words and is found only by whole runs.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, pick, spread

WORDS = 13
WORDS_A_PASS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Patterns:
    """Shift table, hash buckets and patterns of a set of items."""

    def __init__(self, items: Iterable[tuple[int, str | None]], size: int = WORDS):
        self.size = size
        self.ids: dict[str, int] = {}
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}  # block -> where its patterns end in ``text``
        self.text = array("I")
        self.item: list[int] = []  # by order of the items
        self.start: list[int] = []
        for item, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")]
            at = len(self.text)
            self.item.append(item)
            self.start.append(at)
            self.text.extend(ws)
            last = size - 1
            for end in range(at + last, at + len(ws)):
                for j in range(1, size):
                    b = self.text[end - last + j - 1] << 32 | self.text[end - last + j]
                    if last - j < self.shift.get(b, last):
                        self.shift[b] = last - j
                self.bucket.setdefault(self.text[end - 1] << 32 | self.text[end], []).append(end)

    def search(self, text: str) -> set[int]:
        """Items of which a pattern stands in the text."""
        get = self.ids.get
        ws = array("I", [get(w, 0) for w in words_of(text)])
        found: set[int] = set()
        n, size, shift, far = len(ws), self.size, self.shift, self.size - 1
        i = size - 1
        while i < n:
            b = ws[i - 1] << 32 | ws[i]
            s = shift.get(b, far)
            if s:
                i += s
                continue
            window = ws[i - far : i + 1]
            for end in self.bucket[b]:
                if self.text[end - far : end + 1] == window:
                    found.add(self.item[bisect_right(self.start, end) - 1])
            i += 1
        return found


def leaked_items(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id): each text with the items that it leaks."""
    sc = df.sparkSession.sparkContext
    source = spread(pick(df, i=id_col, t=text_col))
    few = pick(items, i=item_col, t=item_text_col).where(F.col("t").isNotNull()).orderBy("i")
    passes: list[DataFrame] = []
    block: list[tuple[int, str]] = []

    def add() -> None:
        held = sc.broadcast(Patterns(block, words))

        def run(b: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "item_id": []}
            for i, t in zip(b["i"], b["t"], strict=True):
                if t:
                    hits = held.value.search(t)
                    out["doc_id"] += [i] * len(hits)
                    out["item_id"] += sorted(hits)
            return out

        passes.append(map_rows(source, run, "doc_id BIGINT, item_id BIGINT"))

    size = 0
    for r in few.toLocalIterator():
        n = len(words_of(r.t))
        if block and size + n > WORDS_A_PASS:
            add()
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block or not passes:
        add()
    return reduce(DataFrame.unionAll, passes).distinct() if len(passes) > 1 else passes[0]
