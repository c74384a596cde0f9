"""Problem 5: keyword-stuffed and link-list pages.

Method: mean pointwise mutual information of neighbouring words.  The words and
pairs of the bodies that it has to decide are counted exactly over all records
(64-bit keys, summed by partition before the shuffle and joined to the bodies),
each record's own counts are taken out again, and the mean PMI of its pairs
tells word salad; excessively repeated collocations tell stuffing (in a list,
repeated ones do, as its entries have no neighbours to speak of).  Counts are
smoothed by fixed shares of the corpus, not by fixed counts, so a verdict does
not depend on the size of the table.  Only bodies without sentences are flagged.
Link lists are told by the share of lines that are no more than links, with
the record's own list of links to tell addresses that lack a scheme.  Null,
empty and blank texts are never reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, pick, save_point, spread
from .profile import Profile, profile, quality_kind
from .residue import Residue, fit_residue

FILTER_BITS = 22
LOW_PMI = 4.0
PAIR_SHARE = 1e-7  # share of the corpus added to the share of each pair
WORD_SHARE = 5e-7  # and of each word
REPEATED = 0.45  # share of a list's words in repeated collocations
EXCESS = 0.7  # and of any body's, whatever its PMI: rare names have no corpus to speak against them
MIN_WORDS = 12  # fewer have too few pairs for a mean
UNSURE = "unsure"  # neither excessive repetition nor links decide: the mean PMI does

_TOKEN = re.compile(r"[^\W\d_]+|\n")
_TARGET = re.compile(r"\]\([^)\s]*\)|<?https?://\S+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_KIND = np.uint64(3)  # the low two bits of a key: 1 a word, 2 a pair, 0 a sum
_WORDS_KEY, _PAIRS_KEY = 0, 4
_FLUSH = 2_000_000

_ids: dict[str, int] = {}


def _hashes(text: str) -> np.ndarray:
    """One 64-bit key per word, 0 for a line end."""
    ids = _ids
    if len(ids) > 500_000:
        ids.clear()
    out = []
    for w in _TOKEN.findall(_TARGET.sub("] ", text).lower()):
        h = ids.get(w)
        if h is None:
            h = ids[w] = 0 if w == "\n" else int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") & ~3 | 1
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) & ~_KIND | np.uint64(2)


def _keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys; first word, second word and key of each pair."""
    ok = h != 0
    both = ok[:-1] & ok[1:]
    a, b = h[:-1][both], h[1:][both]
    return h[ok], a, b, _pair_keys(a, b)


@dataclass
class Terms:
    """What the mean PMI of a text is summed from: keys of words and pairs, how
    often the logarithm of each one's share goes in, its count in the text."""

    keys: np.ndarray
    weights: np.ndarray
    own: np.ndarray
    words: int
    pairs: int


def pmi_terms(text: str) -> Terms | None:
    w, a, b, ab = _keys(_hashes(text))
    if not len(ab):
        return None
    keys, own = np.unique(np.concatenate([w, ab]), return_counts=True)
    weights = np.where(keys & _KIND == 2, own, 0).astype(np.float64)
    np.subtract.at(weights, np.searchsorted(keys, np.concatenate([a, b])), 1.0)
    return Terms(keys.view(np.int64), weights, own, len(w), len(ab))


TERMS = "keys ARRAY<BIGINT>, weights ARRAY<DOUBLE>, own ARRAY<BIGINT>, words BIGINT, pairs BIGINT"


def terms_row(t: Terms | None) -> tuple:
    """The values of TERMS."""
    return (t.keys.tolist(), t.weights.tolist(), t.own.tolist(), t.words, t.pairs) if t else (None,) * 5


@dataclass
class Pairs:
    """Corpus counts: (k, n) by key, and their sums."""

    counts: DataFrame
    n_words: float
    n_pairs: float

    def mean_pmi(self, text: str, own: bool = True) -> float | None:
        """Mean PMI of neighbouring words, the text's own counts left out."""
        t = pmi_terms(text)
        if t is None:
            return None
        n = {r.k: r.n for r in self.counts.where(F.col("k").isin(t.keys.tolist())).collect()}
        pair = t.keys & 3 == 2
        c = np.maximum(np.array([n.get(k, 0) for k in t.keys.tolist()]) - own * t.own, 0)
        total = np.where(pair, max(1.0, self.n_pairs - own * t.pairs), max(1.0, self.n_words - own * t.words))
        return float((t.weights * np.log(c / total + np.where(pair, PAIR_SHARE, WORD_SHARE))).sum() / t.pairs)


def pair_counts(df: DataFrame, text_col: str, keys: DataFrame | None = None) -> Pairs:
    """Exact counts over all records of the words and pairs in ``keys`` (k), or
    of all.  A bit table of fixed size, of the wanted keys, only spares the
    shuffle most of the others; the join decides."""
    wanted = None
    if keys is not None:
        got = keys.select(F.shiftrightunsigned("k", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow()
        wanted = np.zeros(1 << FILTER_BITS, dtype=bool)
        wanted[got["b"].to_numpy()] = True
    bits = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, sums = bits.value, [], 0, [0, 0]

        def flush() -> Iterator[pa.RecordBatch]:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["k", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                w, _, _, ab = _keys(_hashes(t))
                sums[0] += len(w)
                sums[1] += len(ab)
                ks = np.concatenate([w, ab])
                if table is not None:
                    ks = ks[table[(ks >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
                held.append(ks)
                size += len(ks)
                if size > _FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([_WORDS_KEY, _PAIRS_KEY], pa.int64()), pa.array(sums, pa.int64())], names=["k", "n"])

    counts = spread(pick(df, t=text_col).where("length(t) > 0")).mapInArrow(run, "k BIGINT, n BIGINT").groupBy("k").agg(F.sum("n").alias("n"))
    is_sum = F.col("k").isin(_WORDS_KEY, _PAIRS_KEY)
    if keys is not None:
        sums_too = df.sparkSession.createDataFrame([(_WORDS_KEY,), (_PAIRS_KEY,)], "k BIGINT")
        counts = counts.join(keys.select("k").unionAll(sums_too).distinct(), "k", "left_semi")
    counts = save_point(counts)
    sums = {r.k: r.n for r in counts.where(is_sum).collect()}
    return Pairs(counts.where(~is_sum), float(sums.get(_WORDS_KEY, 0)), float(sums.get(_PAIRS_KEY, 0)))


def low_pmi(found: DataFrame, df: DataFrame, text_col: str, pairs: Pairs | None = None) -> DataFrame:
    """The ``row`` of the rows of ``found`` (row, TERMS; keys null where nothing
    is to be decided) whose mean PMI over the records of ``df`` is low."""
    each = found.where("keys IS NOT NULL").select("row", "words", "pairs", F.explode(F.arrays_zip("keys", "weights", "own")).alias("x"))
    each = each.select("row", "words", "pairs", F.col("x.keys").alias("k"), F.col("x.weights").alias("weight"), F.col("x.own").alias("own"))
    p = pairs or pair_counts(df, text_col, each.select("k").distinct())

    def share(total: Column, least: float) -> Column:
        return F.greatest(F.coalesce("n", F.lit(0)) - F.col("own"), F.lit(0)) / F.greatest(total, F.lit(1.0)) + F.lit(least)

    is_pair = F.col("k").bitwiseAND(3) == 2
    part = F.col("weight") * F.log(F.when(is_pair, share(F.lit(p.n_pairs) - F.col("pairs"), PAIR_SHARE)).otherwise(share(F.lit(p.n_words) - F.col("words"), WORD_SHARE)))
    sums = each.join(p.counts, "k", "left").groupBy("row", "pairs").agg(F.sum(part).alias("pmi"))
    return sums.where(F.col("pmi") / F.col("pairs") < LOW_PMI).select("row")


_BREAKS = frozenset("0123456789()")  # numbers and counts part the words on either side
_WORDS = re.compile(r"#?[^\W\d_]{2,}|[\d()]+")


def repetition(p: Profile) -> tuple[int, float]:
    """(words, share of words that stand in collocations found three times or
    more)."""
    n, found, single, pairs = 0, [], Counter(), Counter()
    for line in p.text.split("\n"):
        ws = _WORDS.findall(line.lower())
        prs = [(a, b) for a, b in zip(ws, ws[1:], strict=False) if a[0] not in _BREAKS and b[0] not in _BREAKS]
        ws = [w for w in ws if w[0] not in _BREAKS]
        n += len(ws)
        single.update(ws)
        pairs.update(prs)
        found.append(prs)
    if not n:
        return 0, 0.0
    total = sum(map(len, found))
    often = sum(pairs[x] >= 3 for prs in found for x in prs)
    tags = sum(c for w, c in single.items() if w[0] == "#")
    if tags * 2 > n:  # a run of tags: the tags themselves repeat
        return n, sum(c for w, c in single.items() if c >= 2) / n
    return n, often / total if total else 0.0


_SCHEME = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//", re.I)


def _address(s: str) -> str:
    """An address without scheme, ``www.`` and trailing slashes."""
    return _SCHEME.sub("", s.strip("<>()[],;")).lower().removeprefix("www.").rstrip("/")


def with_addresses(p: Profile, links: list[str | None] | None) -> Profile:
    """The profile, lines that only spell out addresses of the record's links
    (without a scheme, so that nothing marks them as such) counted as links."""
    if not links or not p.other or not any("." in s for s in p.text.split("\n")):
        return p
    known = {_address(x) for x in links if x}
    hits = [s for s in p.text.split("\n") if (ws := s.split()) and any("." in w and _address(w) in known for w in ws) and len(ws) <= 4]
    size = sum(map(len, hits))
    return replace(p, links=p.links + len(hits), n_links=p.n_links + len(hits), link_chars=p.link_chars + size, other=p.other - len(hits), other_chars=p.other_chars - size) if hits else p


def spam_kind(p: Profile) -> str | None:
    """keywords, links, None or UNSURE for a profile (residue is judged before).
    A case holds one sentence at most, so bodies of more are none."""
    rows = p.rows
    if not rows or p.prose > 1 or p.sentences > 2:
        return None
    rest = p.chars - p.prose_chars
    if p.n_links >= 4 and p.link_chars >= 0.6 * max(1, rest) and p.links >= 1:
        return "links"
    if p.cells >= rows / 2 or p.links >= rows / 2:
        return None
    kind = quality_kind(p)[0]
    if kind in ("junk", "table"):
        return None
    n, often = repetition(p)
    if n < MIN_WORDS:
        return None
    if kind == "list":  # a list of anything but the same collocations is a list
        return "keywords" if often >= REPEATED else None
    if often >= EXCESS:
        return "keywords"
    return None if p.prose_chars > 0.3 * p.chars and often < REPEATED else UNSURE


def spam_records(
    df: DataFrame, id_col: str, text_col: str, status_col: str | None = None, links_col: str | None = None, model: Residue | None = None, pairs: Pairs | None = None
) -> DataFrame:
    """(page_id, kind) of keyword and link pages; records that the residue
    model reports are left out."""
    held = df.sparkSession.sparkContext.broadcast(model or fit_residue(df, id_col, text_col, status_col))
    cols = {"i": id_col, "t": text_col} | ({"l": links_col} if links_col else {})

    def run(b: dict[str, list]) -> dict[str, list]:
        residue = held.value
        rows = []
        for i, t, links in zip(b["i"], b["t"], b.get("l") or [None] * len(b["i"]), strict=True):
            if t:
                p = with_addresses(profile(t), links)
                k = spam_kind(p)
                terms = pmi_terms(p.text) if k == UNSURE else None
                if k and (k != UNSURE or terms) and not residue.kind(p):
                    rows.append((i, k, *terms_row(terms)))
        names = ("page_id", "kind", "keys", "weights", "own", "words", "pairs")
        return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

    found = map_rows(spread(pick(df, **cols)), run, f"page_id BIGINT, kind STRING, {TERMS}")
    found = save_point(found.withColumn("row", F.monotonically_increasing_id()))
    low = found.where(F.col("kind") == UNSURE).join(low_pmi(found, df, text_col, pairs), "row", "left_semi")
    return found.where(F.col("kind") != UNSURE).select("page_id", "kind").unionAll(low.select("page_id", F.lit("keywords").alias("kind")))
