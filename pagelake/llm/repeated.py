"""Problem 6: lines repeated across one site's documents.

Method: the line identifiers of a source's documents are concatenated and their
suffix array is built by prefix doubling, with the longest common prefixes of
neighbouring suffixes read from the doubling ranks.  An interval of suffixes
with a common prefix is a repeated block of that many lines; blocks of any length
that span enough documents are found (``repeated_blocks`` lists them with their
full length), and every line inside one is a repeated line.  A source of more
than ``SHARD_DOCS`` documents is dealt out over shards by hash of the document:
every shard builds its own suffix array and sends the intervals of each length
asked for, by hash of the block, with their document counts, which are summed
over the shards (exactly: all intervals are sent), so no task ever holds a whole
large source.  As a line of a repeated block is a repeated line itself, the lines
of a large source need its intervals of one line only.

Lines are the same if they differ only in case, white space, digits or edge
characters.  Documents without a source, and null or empty texts, have no lines
(they count as documents of their source).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, save_point, spread

SHARD_DOCS = 4000
MIN_DOCS = 4
MIN_SHARE = 0.1
HOT_SOURCES = 20_000  # sources with shards that fit into a closure; beyond, they are joined
SMALL_SETS = 4_000_000  # identifiers (8 bytes each) that may be broadcast

_DIGITS = re.compile(r"\d+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def host_column(url: str) -> F.Column:
    """Host of a URL in lower case, without ``www.``, user and port; null for none."""
    h = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)", 1)
    return F.when(h != "", h)


def normal_line(line: str) -> str:
    """Same text for lines that count as the same; '' for lines without letters."""
    if not _HAS_LETTER.search(line):
        return ""
    s = " ".join(line.lower().split())
    return _DIGITS.sub("0", _EDGE.sub("", s))


_cache: dict[str, int] = {}


def line_ids(text: str) -> list[int]:
    """One identifier per line; 0: blank, -1: no letters or fenced code."""
    ids = _cache
    if len(ids) > 300_000:
        ids.clear()
    out: list[int] = []
    fence = ""
    for line in text.split("\n"):
        h = ids.get(line)
        if h is None:
            s = line.strip()
            if not s:
                h = 0
            elif s[:3] in ("```", "~~~"):
                h = -2
            else:
                n = normal_line(line)
                h = -1 if not n else ((crc32(n.encode()) << 31) ^ crc32(n[::-1].encode() + b"#")) & 0x7FFFFFFFFFFFFFFF or 1
            ids[line] = h
        if h == -2:
            mark = line.strip()[:3]
            fence = "" if fence == mark else fence or mark
            out.append(-1)
        else:
            out.append(-1 if fence and h else h)
    return out


class SuffixArray:
    """Suffixes of a sequence in order, and the common prefixes of neighbours."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        keys, rank = np.unique(ids, return_inverse=True)
        rank = rank.astype(np.int64)
        ranks, size = [rank], 1  # ranks by the first 1, 2, 4, ... identifiers
        groups = len(keys)
        while groups < n and size < n:
            nxt = np.full(n, -1, dtype=np.int64)
            nxt[: n - size] = rank[size:]
            keys, rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)
            rank = rank.astype(np.int64)
            ranks.append(rank)
            groups, size = len(keys), size * 2
        self.order = np.argsort(rank, kind="stable")
        # common prefix of each suffix with the one before it: from the widest rank that agrees down
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        lcp = np.zeros(max(0, n - 1), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            live = (a < n) & (b < n)
            same = np.zeros(len(lcp), dtype=bool)
            same[live] = ranks[k][a[live]] == ranks[k][b[live]]
            step = np.where(same, 1 << k, 0)
            lcp += step
            a += step
            b += step
        self.lcp = np.concatenate([[0], lcp])

    def intervals(self, length: int) -> np.ndarray:
        """Number of the interval, of a common prefix of ``length`` at least, of
        each suffix in order."""
        return np.cumsum(self.lcp < length) - 1


class Shard:
    """Documents of one source (or of one shard of it)."""

    def __init__(self, pages: list[int], lines: list[list[int]]):
        self.pages = pages
        ids, doc, at = [], [], []
        fresh = -1
        for d, ls in enumerate(lines):
            for n, h in enumerate(ls):
                if h > 0:
                    ids.append(h)
                    doc.append(d)
                    at.append(n)
                elif h < 0:  # breaks a block
                    fresh -= 1
                    ids.append(fresh)
                    doc.append(d)
                    at.append(-1)
            fresh -= 1
            ids.append(fresh)
            doc.append(d)
            at.append(-1)
        self.ids, self.doc, self.at = np.array(ids, dtype=np.int64), np.array(doc, dtype=np.int64), np.array(at, dtype=np.int64)

        self.suffixes = SuffixArray(self.ids)

    def _spans(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of each suffix in order, documents of each interval."""
        run = self.suffixes.intervals(length)
        doc = self.doc[self.suffixes.order]
        pairs = np.unique(run * (int(doc.max()) + 1) + doc)
        return run, np.bincount(pairs // (int(doc.max()) + 1), minlength=int(run[-1]) + 1)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(identifier, documents) of the intervals of one line."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run, docs = self._spans(1)
        first = self.suffixes.order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
        ok = self.at[first] >= 0
        return self.ids[first[ok]], docs[ok]

    def blocks(self, least: float) -> list[tuple[int, int, int]]:
        """(first position, lines, documents) of the repeated blocks: for 1, 2, 4,
        ... lines the intervals that span enough documents, in the full length of
        their common prefix."""
        got: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(self.ids):
            return []
        order, lcp = self.suffixes.order, self.suffixes.lcp
        length = 1
        while length <= len(self.ids):
            run, docs = self._spans(length)
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            ends = np.r_[starts[1:], len(run)]
            hits = np.flatnonzero((docs >= least) & (self.at[order[starts]] >= 0))
            if not len(hits):
                break
            for k in hits.tolist():
                i, j = int(starts[k]), int(ends[k])
                full = int(lcp[i + 1 : j].min()) if j - i > 1 else length
                got[i, j] = (int(order[i]), full, int(docs[k]))
            length *= 2
        return list(got.values())

    def found(self, least: float) -> tuple[list[int], list[int]]:
        """(page, line number) of every line inside a block of at least
        ``least`` documents."""
        if not len(self.ids):
            return [], []
        covered = np.zeros(len(self.ids) + 1, dtype=np.int64)  # +1 where a block begins, -1 behind its end
        order, lcp = self.suffixes.order, self.suffixes.lcp
        length = 1
        while length <= len(self.ids):
            run, docs = self._spans(length)
            wide = docs[run] >= least
            if not wide.any():
                break
            begin = order[wide]
            np.add.at(covered, begin, 1)
            np.add.at(covered, np.minimum(begin + length, len(self.ids)), -1)
            length *= 2
        hit = np.flatnonzero((np.cumsum(covered[:-1]) > 0) & (self.at >= 0))
        return [self.pages[d] for d in self.doc[hit]], self.at[hit].tolist()

    def found_ids(self, least: float) -> np.ndarray:
        """Identifiers of the lines inside such blocks."""
        page, line = self.found(least)
        where = {(self.pages[d], n): i for d, n, i in zip(self.doc.tolist(), self.at.tolist(), self.ids.tolist(), strict=True)}
        return np.unique(np.array([where[x] for x in zip(page, line, strict=True)], dtype=np.int64))


STAGE = "kind INT, source STRING, key BIGINT, n BIGINT"  # kind 0: (page, line) found; 1: (line id, documents) of a shard; 2: line id found


def _by_shard(batches: Iterator[pa.RecordBatch], only_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """Groups of a partition sorted by source and shard, one after the other."""
    target = pa.schema([("kind", pa.int32()), ("source", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
    for key, pages, lines in _groups(batches):
        s = Shard(pages, lines)
        least = max(MIN_DOCS, MIN_SHARE * len(pages))
        if key[2] == 1 and only_ids:
            ids = s.found_ids(least)
            cols = [[2] * len(ids), [key[0]] * len(ids), ids, [0] * len(ids)]
        elif key[2] == 1:
            page, line = s.found(least)
            cols = [[0] * len(page), [None] * len(page), page, line]
        else:
            ids, docs = s.counts()
            cols = [[1] * len(ids), [key[0]] * len(ids), ids, docs]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, target, strict=True)], schema=target)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[list[int]]]]:
    """((source, shard, shards), pages, lines) of a sorted partition, one after the other."""
    key: tuple | None = None
    pages: list[int] = []
    lines: list[list[int]] = []
    for b in batches:
        for source, shard, shards, page, ids in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if key != (source, shard, shards):
                if pages:
                    yield key, pages, lines
                key, pages, lines = (source, shard, shards), [], []
            pages.append(page)
            lines.append(ids)
    if pages:
        yield key, pages, lines


def _documents(df: DataFrame, id_col: str, text_col: str, url_col: str, shard_docs: int) -> tuple[DataFrame, DataFrame, bool]:
    """(documents by source and shard with their line identifiers, sizes of the
    sources, whether any source has shards)."""
    base = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(url_col).alias("u"))
    base = base.select("i", "t", host_column("u").alias("source")).where("source IS NOT NULL")
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > shard_docs)
    hot = {r.source: r.n for r in large.limit(HOT_SOURCES + 1).collect()}
    many = len(hot) > HOT_SOURCES
    any_hot = bool(hot)
    if many:
        base = base.join(large.withColumnRenamed("n", "size"), "source", "left").select("i", "t", "source", "size")
        hot = {}
    else:
        base = base.withColumn("size", F.lit(None).cast("long"))

    def run(b: dict[str, list]) -> dict[str, list]:
        size = [hot.get(s, 0) if n is None else n for s, n in zip(b["source"], b["size"], strict=True)]
        shards = [max(1, -(-n // shard_docs)) if n > shard_docs else 1 for n in size]
        return {
            "source": b["source"],
            "shard": [crc32(str(i).encode()) % k if k > 1 else 0 for i, k in zip(b["i"], shards, strict=True)],
            "shards": shards,
            "page": b["i"],
            "ids": [line_ids(t) if t else [] for t in b["t"]],
        }

    docs = save_point(map_rows(spread(base), run, "source STRING, shard INT, shards INT, page BIGINT, ids ARRAY<BIGINT>"))
    return docs, sizes, any_hot


def _sorted(docs: DataFrame) -> DataFrame:
    return docs.repartition("source", "shard").sortWithinPartitions("source", "shard")


def _often(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, often): the identifiers of a source's repeated lines.  A source
    has at most (lines of a document) / MIN_SHARE of them, so one array holds
    them whatever the source's size."""
    total = counts.groupBy("source", "key").agg(F.sum("n").alias("docs"))
    keep = (F.col("docs") >= MIN_DOCS) & (F.col("docs") >= MIN_SHARE * F.col("n"))
    return total.join(sizes, "source").where(keep).groupBy("source").agg(F.collect_list("key").alias("often"))


def repeated_lines(df: DataFrame, id_col: str, text_col: str, url_col: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(page_id, line_no) of every line that stands in at least MIN_DOCS and
    MIN_SHARE of its source's documents.  ``shard_docs``: documents a task holds
    at most of one source, about."""
    docs, sizes, any_hot = _documents(df, id_col, text_col, url_col, shard_docs)
    stage = _sorted(docs).mapInArrow(_by_shard, STAGE)
    if any_hot:
        stage = save_point(stage)
    found = stage.where("kind = 0").select(F.col("key").alias("page_id"), F.col("n").cast("int").alias("line_no"))
    if not any_hot:
        return found
    often = save_point(_often(stage.where("kind = 1"), sizes))
    few = (often.agg(F.sum(F.size("often")).alias("n")).collect()[0].n or 0) <= SMALL_SETS
    sharded = docs.where("shards > 1")
    rest = sharded.join(F.broadcast(often) if few else often.hint("merge"), "source").select("page", "ids", "often")

    def mark(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"page_id": [], "line_no": []}
        held: tuple[list, set] = ([], set())
        for page, ids, keys in zip(b["page"], b["ids"], b["often"], strict=True):
            if held[0] != keys:
                held = (keys, set(keys))
            hits = [n for n, h in enumerate(ids) if h in held[1]]
            out["page_id"] += [page] * len(hits)
            out["line_no"] += hits
        return out

    return found.unionAll(map_rows(rest, mark, "page_id BIGINT, line_no INT"))


BLOCKS = "source STRING, first_page BIGINT, first_line INT, lines INT, docs INT"


def repeated_blocks(df: DataFrame, id_col: str, text_col: str, url_col: str, least_lines: int = 2, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(source, first_page, first_line, lines, docs) of the blocks of ``least_lines``
    or more lines that span enough documents of a source, each in the full length
    of its common prefix and where it is found first.  A source of more than
    ``shard_docs`` documents is read by shards, each with its own counts."""
    docs, _, _ = _documents(df, id_col, text_col, url_col, shard_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pages, lines in _groups(batches):
            s = Shard(pages, lines)
            got = [x for x in s.blocks(max(MIN_DOCS, MIN_SHARE * len(pages))) if x[1] >= least_lines]
            cols = [[key[0]] * len(got), [pages[s.doc[i]] for i, _, _ in got], [int(s.at[i]) for i, _, _ in got], [n for _, n, _ in got], [d for _, _, d in got]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["source", "first_page", "first_line", "lines", "docs"])

    return _sorted(docs).mapInArrow(run, BLOCKS)


def without_repeated_lines(df: DataFrame, id_col: str, text_col: str, url_col: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(page_id, text): every text without its source's repeated lines.  The
    sources' lists are broadcast if they are small (``SMALL_SETS`` identifiers in
    all), so that no text is shuffled; larger ones are joined."""
    docs, sizes, _ = _documents(df, id_col, text_col, url_col, shard_docs)
    stage = save_point(_sorted(docs).mapInArrow(lambda batches: _by_shard(batches, True), STAGE))
    small = stage.where("kind = 2").groupBy("source").agg(F.collect_list("key").alias("often"))
    often = save_point(small.unionByName(_often(stage.where("kind = 1"), sizes)))
    total = often.agg(F.sum(F.size("often")).alias("n")).collect()[0].n or 0
    few = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), host_column(url_col).alias("source"))
    few = few.join(F.broadcast(often) if total <= SMALL_SETS else often.hint("merge"), "source", "left")

    def clean(b: dict[str, list]) -> dict[str, list]:
        out: list[str | None] = []
        held: tuple[list, set] = ([], set())
        for t, keys in zip(b["t"], b["often"], strict=True):
            if not t or not keys:
                out.append(t)
                continue
            if held[0] != keys:
                held = (keys, set(keys))
            out.append("\n".join(x for x, h in zip(t.split("\n"), line_ids(t), strict=True) if h not in held[1]))
        return {"page_id": b["i"], "text": out}

    return map_rows(few.select("i", "t", "often"), clean, "page_id BIGINT, text STRING")
