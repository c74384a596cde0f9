"""Problem 3: missing or wrong language labels, and mixed documents.

Method: a linear-chain conditional random field labels every word with one of
eleven languages.  Features of a word: the word itself, affixes, character
trigrams, its script and the lexica of function words; transitions between the
languages of neighbouring words are learned.  Forward-backward over whole blocks
gives each word's marginals; their sums give a block or a record its language,
their mean the confidence, and runs of words that lean to one language the
segments of a block.  A text no language reaches ``LEAST_CONFIDENCE`` for is in
another one (``OTHER``) and neither mixed nor wrongly labelled.

The field is trained here on a bounded sample (``SAMPLE_RECORDS`` records by
hash of the id, ``BLOCKS`` blocks a language) of blocks whose label agrees with
their function words, with code-switched sequences made from pairs of blocks.
Null, empty and letterless texts have no language and are never cases; a code
block has no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, pick, sample, save_point, spread
from .lexicon import LANGS, STOPWORDS
from .lines import find_links
from .profile import profile
from .quality import verdicts
from .residue import Residue, fit_residue
from .spam import TERMS, UNSURE, Pairs, low_pmi, pmi_terms, terms_row, with_addresses

SAMPLE_RECORDS = 6000
BLOCKS = 160
CHUNK = 64  # words of a training sequence, at most
LEAST_CONFIDENCE = 0.4
OTHER = "other"
CELLS = 400_000  # words of the sequences that are read together
LONG, OVERLAP = 100_000, 200  # a longer sequence is read in parts that overlap, by far more words than a message carries
SWITCHED = 0.85  # share of a block's first language below which it is searched for segments
SEGMENT_WORDS = 4  # of a segment, at least
BITS = 16
N = len(LANGS)
MIN_LETTERS = 40

# Language codes and names, all spellings in lower case (fixed values).
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski", "ru": "ru rus russian русский", "ja": "ja jpn japanese 日本語",
}
_BY_NAME = {n: k for k, v in NAMES.items() for n in v.split()}
_NO_LANGUAGE = frozenset(("", "und", "unknown", "x-default", "mul", "mis", "zxx", "none", "null", "n/a", "xx"))

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_HAN, _KANA, MIN_HAN = re.compile(r"[一-鿿]"), re.compile(r"[ぁ-ヿ]"), 12  # so many Han characters without kana are no Japanese
_SCRIPTS = re.compile(r"[ぁ-ヿ一-鿿々ー]+|[^ぁ-ヿ一-鿿々ー]+")
_URL = re.compile(r"<?https?://\S+|\]\([^)\s]*\)")
_TAG = re.compile(r"<[^<>]*>")
_MARKED = re.compile(r"^\s*(?:[-*+•]\s|\d{1,3}[.)]\s|#{1,6}(?:\s|$))", re.M)
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def label_of(raw: str | None) -> str | None:
    """The language a label names: a code of LANGS, another label's own text in
    lower case, or None where it names none."""
    if raw is None:
        return None
    s = raw.strip().lower()
    if s in _NO_LANGUAGE:
        return None
    base = re.split(r"[-_]", s)[0]
    return _BY_NAME.get(s) or _BY_NAME.get(base) or s


@dataclass
class Block:
    number: int
    text: str
    letters: int
    plain: bool  # may give a row: enough letters, no list, heading, link or code
    code: bool


REMEMBERED = 400  # characters of a block that is looked up, as many (menus, notices) come again and again
_looked: dict[str, tuple[int, bool]] = {}


def _looks(text: str) -> tuple[int, bool]:
    """(letters, whether they are enough and no list, heading or link stands there)."""
    got = _looked.get(text)
    if got is None:
        letters = sum(map(len, _LETTERS.findall(text)))
        got = letters, letters >= MIN_LETTERS and not _MARKED.search(text) and not find_links(text)
        if len(text) <= REMEMBERED:
            if len(_looked) > 200_000:
                _looked.clear()
            _looked[text] = got
    return got


def blocks(markdown: str) -> list[Block]:
    """Runs of non-blank lines, numbered from 0."""
    out: list[Block] = []
    run: list[str] = []
    fence = run_code = False

    def close() -> None:
        nonlocal run, run_code
        if run:
            text = "\n".join(run)
            letters, plain = _looks(text)
            out.append(Block(len(out), text, letters, plain and not run_code, run_code))
        run, run_code = [], fence

    for line in markdown.split("\n"):
        if not line.strip():
            close()
            continue
        if _FENCE.match(line):
            fence = not fence
            run_code = True
        run_code = run_code or fence
        run.append(line)
    close()
    return out


def words_of(text: str) -> list[str]:
    if "://" in text or "](" in text:
        text = _URL.sub(" ", text)
    if "</" in text or "<br" in text:
        text = _TAG.sub(" ", text)
    words = _WORD.findall(text.lower())
    if not text.isascii() and any(w[-1] > "぀" or w[0] > "぀" for w in words):  # runs end where the script changes
        words = [x for w in words for x in (_SCRIPTS.findall(w) if w[-1] > "぀" or w[0] > "぀" else (w,))]
    return words


def features(word: str) -> list[int]:
    got = [crc32(f"w {word}".encode()), crc32(_script(word).encode())]
    w = f"^{word}$"
    for n in (2, 3, 4):
        got.append(crc32(f"p {w[:n]}".encode()))
        got.append(crc32(f"s {w[-n:]}".encode()))
    got += [crc32(f"t {w[i : i + 3]}".encode()) for i in range(len(w) - 2)]
    got += [crc32(f"l {k}".encode()) for k, v in STOPWORDS.items() if word in v]
    return [h >> (32 - BITS) for h in got]


def _script(word: str) -> str:
    c = word[0]
    if c < "ɐ":
        return "latin" if c < "\u0080" else "latin+"
    if "Ѐ" <= c <= "ӿ":
        return "cyrillic"
    if "ぁ" <= c <= "ヿ":
        return "kana"
    return "han" if "一" <= c <= "鿿" else "other"


@dataclass
class Crf:
    weights: np.ndarray  # (2^BITS, N)
    trans: np.ndarray  # (N, N)

    def __post_init__(self) -> None:
        self._ids: dict[str, int] = {}
        self.shares: dict[str, np.ndarray | None] = {}  # languages of short blocks
        self._rows = np.zeros((4096, N), dtype=np.float32)

    def emission_ids(self, words: list[str]) -> list[int]:
        ids = self._ids
        out = []
        for w in words:
            i = ids.get(w)
            if i is None:
                i = len(ids)
                if i == len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
                self._rows[i] = self.weights[features(w)].sum(axis=0)
                ids[w] = i
            out.append(i)
        return out

    def reset(self) -> None:
        if len(self._ids) > 300_000:
            self._ids.clear()

    def marginals(self, seqs: list[list[str]]) -> Iterator[tuple[list[tuple[int, list[int], int, int]], np.ndarray]]:
        """Groups of (number of the sequence, words, first and end of those to
        keep) with the marginals of their words; a long sequence comes in several
        parts."""
        self.reset()
        parts: list[tuple[int, list[int], int, int]] = []  # sequence, words, those to keep
        for k, s in enumerate(seqs):
            ids = self.emission_ids(s)
            for i in range(0, len(ids), LONG):
                low, high = max(0, i - OVERLAP), i + LONG + OVERLAP
                part = ids[low:high]
                parts.append((k, part, i - low, min(i + LONG, len(ids)) - low))
        order = sorted(range(len(parts)), key=lambda j: -len(parts[j][1]))
        a = np.exp(self.trans).astype(np.float32)
        at = 0
        while at < len(order):
            top = len(parts[order[at]][1])
            group = order[at : at + max(1, CELLS // top)]
            at += len(group)
            lens = np.array([len(parts[j][1]) for j in group])
            flat = np.zeros((len(group), top), dtype=np.int64)
            for r, j in enumerate(group):
                flat[r, : lens[r]] = parts[j][1]
            yield [parts[j] for j in group], _forward_backward(self._rows[flat], lens, a)[0]

    def marginal_sums(self, seqs: list[list[str]]) -> np.ndarray:
        """(len(seqs), N): the sum of the words' marginals of each sequence."""
        out = np.zeros((len(seqs), N))
        for group, m in self.marginals(seqs):
            sums = m.sum(axis=1)  # zero behind the ends
            for r, (_, part, low, high) in enumerate(group):
                if low or high < len(part):
                    sums[r] = m[r, low:high].sum(axis=0)
            np.add.at(out, [k for k, *_ in group], sums)
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, end, language, confidence): runs of words that lean to one
        language; runs of fewer than SEGMENT_WORDS go to the one before."""
        if not words:
            return []
        m = np.concatenate([x for i in range(0, len(words), LONG) for _, m in self.marginals([words[i : i + LONG]]) for x in m])
        best = m.argmax(axis=1)
        cuts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        runs = [[int(i), int(j), int(best[i])] for i, j in zip(cuts, np.r_[cuts[1:], len(best)], strict=True)]
        out: list[list[int]] = []
        for run in runs:
            if out and (run[1] - run[0] < SEGMENT_WORDS or run[2] == out[-1][2]):
                out[-1][1] = run[1]
            elif out and out[-1][1] - out[-1][0] < SEGMENT_WORDS:  # a short first run
                out[-1][1:] = run[1:]
            else:
                out.append(run)
        return [(i, j, LANGS[k], float(m[i:j, k].mean())) for i, j, k in out]


def _forward_backward(e: np.ndarray, lens: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (B, T, N) of sequences sorted by falling length, zero behind
    their ends; also the scaled forward, backward and emission factors."""
    b, top, _ = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    live = [int(np.searchsorted(-lens, -t, side="left")) for t in range(top)]  # rows with lens > t
    f = np.zeros_like(p)
    g = np.zeros_like(p)
    f[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, top):
        n = live[t]
        x = (f[:n, t - 1] @ a) * p[:n, t]
        f[:n, t] = x / x.sum(axis=1, keepdims=True)
    g[np.arange(b), lens - 1] = 1.0
    for t in range(top - 2, -1, -1):
        n = live[t + 1]
        x = (p[:n, t + 1] * g[:n, t + 1]) @ a.T
        g[:n, t] = x / x.sum(axis=1, keepdims=True)
    m = f * g
    m /= np.maximum(m.sum(axis=2, keepdims=True), 1e-30)
    m[f.sum(axis=2) == 0] = 0.0
    return m, f, g, p


def train(labelled: list[tuple[str, list[str]]], epochs: int = 5, seed: int = 7) -> Crf:
    """CRF by gradient ascent (AdaGrad) on (language, words of a block)."""
    rng = np.random.default_rng(seed)
    pool: dict[str, list[list[str]]] = {k: [] for k in LANGS}
    long_ones = dict.fromkeys(LANGS, 0)
    short_ones = dict.fromkeys(LANGS, 0)
    for k, ws in labelled:
        held = long_ones if len(ws) > 12 else short_ones
        if held[k] < BLOCKS * (1 if held is long_ones else 3):
            held[k] += 1
            pool[k].append(ws[:CHUNK])
    for k in LANGS:  # function words as sequences of their own, so that every language is known
        s = sorted(STOPWORDS[k])
        pool[k] += [list(rng.permutation(s)[:12]) for _ in range(6)]
    seqs: list[tuple[list[str], list[int]]] = []
    for k, many in pool.items():
        y = LANGS.index(k)
        seqs += [(ws, [y] * len(ws)) for ws in many]
    mixed = []
    for i in rng.permutation(len(seqs))[: len(seqs) // 3]:
        j = int(rng.integers(len(seqs)))
        (x1, y1), (x2, y2) = seqs[int(i)], seqs[j]
        mixed.append((x1[: len(x1) // 2] + x2[len(x2) // 2 :], y1[: len(y1) // 2] + y2[len(y2) // 2 :]))
    seqs = [(x, y) for x, y in seqs + mixed if x]
    w = np.zeros((1 << BITS, N))
    tr = np.eye(N) * 1.0
    hw, ht = np.full((1 << BITS, N), 1e-2), np.full((N, N), 1.0)
    feats = [[features(x) for x in xs] for xs, _ in seqs]
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for start in range(0, len(order), 256):
            group = sorted(order[start : start + 256], key=lambda i: -len(seqs[i][0]))
            lens = np.array([len(seqs[i][0]) for i in group])
            top = int(lens[0])
            flat = [fs for i in group for fs in feats[i]]
            sizes = np.array([len(x) for x in flat])
            idx = np.fromiter((h for x in flat for h in x), dtype=np.int64)
            em = np.add.reduceat(w[idx], np.cumsum(np.r_[0, sizes[:-1]]), axis=0)
            e = np.zeros((len(group), top, N))
            gold = np.zeros((len(group), top, N))
            at = 0
            for r, i in enumerate(group):
                n = len(seqs[i][0])
                e[r, :n] = em[at : at + n]
                gold[r, np.arange(n), seqs[i][1]] = 1.0
                at += n
            a = np.exp(tr)
            m, f, g, p = _forward_backward(e, lens, a)
            d = gold - m
            dt = np.zeros((N, N))
            for t in range(1, top):
                n = int((lens > t).sum())
                xi = f[:n, t - 1, :, None] * a[None] * (p[:n, t] * g[:n, t])[:, None, :]
                xi /= np.maximum(xi.sum(axis=(1, 2), keepdims=True), 1e-30)
                dt += gold[:n, t - 1].T @ gold[:n, t] - xi.sum(axis=0)
            dw = np.concatenate([d[r, :n] for r, n in enumerate(lens)])
            wide = np.repeat(dw, sizes, axis=0)
            used, inv = np.unique(idx, return_inverse=True)
            gw = np.stack([np.bincount(inv, weights=wide[:, c], minlength=len(used)) for c in range(N)], axis=1) - 1e-3 * w[used]
            hw[used] += gw**2
            w[used] += 0.25 * gw / np.sqrt(hw[used])
            dt -= 0.1 * (tr - np.eye(N))
            ht += dt**2
            tr += 0.1 * dt / np.sqrt(ht)
    return Crf(w.astype(np.float32), tr.astype(np.float32))


def vote(words: list[str], text: str) -> str | None:
    """The language whose function words a block holds most clearly."""
    hits = {k: sum(x in v for x in words) for k, v in STOPWORDS.items() if k != "ja"}
    kana = sum("ぁ" <= c <= "ヿ" for c in text)
    if kana * 4 > len(text):
        return "ja"
    first, second = sorted(hits.values())[-1:-3:-1]
    return max(hits, key=hits.__getitem__) if first >= 4 and first >= 1.5 * second else None


def training_blocks(text: str, lang: str) -> list[list[str]]:
    """Words of a record's blocks if every block with a clear vote agrees with
    the label: two of those, and all shorter blocks (menus, notices, tables)."""
    sure, short = [], []
    for x in blocks(text):
        if x.code or not (ws := words_of(x.text)):
            continue
        v = vote(ws, x.text)
        if v == lang:
            sure.append(ws[:CHUNK])
        elif v:
            return []
        else:
            short.append(ws[:CHUNK])
    return sure[:2] + short if sure else []


def fit_languages(df: DataFrame, id_col: str, text_col: str, label_col: str) -> Crf:
    few = sample(df, SAMPLE_RECORDS, id_col, i=id_col, t=text_col, l=label_col).where(F.length("t") > 0)

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"i": [], "lang": [], "words": []}
        for i, t, raw in zip(b["i"], b["t"], b["l"], strict=True):
            lang = label_of(raw)
            for ws in training_blocks(t, lang) if lang in NAMES else []:
                out["i"].append(i)
                out["lang"].append(lang)
                out["words"].append(ws)
        return out

    got = map_rows(spread(few), run, "i BIGINT, lang STRING, words ARRAY<STRING>").toArrow().sort_by("i")
    return train(list(zip(got["lang"].to_pylist(), got["words"].to_pylist(), strict=True)))


@dataclass
class Reading:
    whole: str  # language of most of the text
    confidence: float
    parts: list[tuple[int, str, float, bool]]  # block number, language, confidence, may give a row


def _named(share: np.ndarray) -> tuple[str, float]:
    best = int(share.argmax())
    sure = float(share[best])
    return (LANGS[best] if sure >= LEAST_CONFIDENCE else OTHER), sure


def read_languages(texts: list[str], crf: Crf) -> list[Reading | None]:
    """Languages of records and of their blocks; None without letters."""
    held = crf.shares
    if len(held) > 200_000:
        held.clear()
    fresh: dict[str, list[str]] = {}
    meta = [[x for x in blocks(t) if not x.code] for t in texts]
    for mine in meta:
        for x in mine:
            if x.text not in held and x.text not in fresh:
                fresh[x.text] = words_of(x.text)
    known = {t: ws for t, ws in fresh.items() if ws}
    sums = crf.marginal_sums(list(known.values()))
    here = dict.fromkeys(fresh) | dict(zip(known, sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9), strict=True))
    held.update((t, s) for t, s in here.items() if len(t) <= REMEMBERED)
    out: list[Reading | None] = []
    for mine in meta:
        total, foreign = np.zeros(N), 0
        parts = []
        for x in mine:
            share = here[x.text] if x.text in here else held[x.text]
            if share is None:
                continue
            total += share * x.letters
            lang, sure = _named(share)
            if lang == "ja" and len(_HAN.findall(x.text)) >= MIN_HAN and not _KANA.search(x.text):
                lang, foreign = OTHER, foreign + x.letters  # Chinese
            parts.append((x.number, lang, sure, x.plain))
        if not parts:
            out.append(None)
            continue
        lang, sure = _named(total / max(total.sum(), 1e-9))
        out.append(Reading(OTHER if lang == "ja" and 2 * foreign > total.sum() else lang, sure, parts))
    return out


SCHEMA = "page_id BIGINT, block_no INT, segment_no INT, lang STRING, confidence DOUBLE, plain BOOLEAN"


def detect_languages(df: DataFrame, id_col: str, text_col: str, crf: Crf) -> DataFrame:
    """Language and confidence of every record (block_no -1), block (segment_no
    -1) and, in blocks that switch language, segment."""
    held = df.sparkSession.sparkContext.broadcast(crf)

    def run(b: dict[str, list]) -> dict[str, list]:
        cols: list[list] = [[] for _ in range(6)]
        keep = [(i, t) for i, t in zip(b["i"], b["t"], strict=True) if t]
        for start in range(0, len(keep), 400):
            some = keep[start : start + 400]
            for (i, t), r in zip(some, read_languages([t for _, t in some], held.value), strict=True):
                if not r:
                    continue
                rows = [(i, -1, -1, r.whole, r.confidence, True)] + [(i, n, -1, *x) for n, *x in r.parts]
                unsure = {n for n, _, sure, _ in r.parts if sure < SWITCHED}
                for x in blocks(t) if unsure else ():
                    if x.number in unsure:
                        found = held.value.segments(words_of(x.text))
                        if len(found) > 1:
                            rows += [(i, x.number, k, lang, sure, False) for k, (_, _, lang, sure) in enumerate(found)]
                for row in rows:
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
        return dict(zip(("page_id", "block_no", "segment_no", "lang", "confidence", "plain"), cols, strict=True))

    return map_rows(spread(pick(df, i=id_col, t=text_col)), run, SCHEMA)


def language_found(
    df: DataFrame, id_col: str, text_col: str, label_col: str, status_col: str | None = None, links_col: str | None = None, crf: Crf | None = None, residue: Residue | None = None, pairs: Pairs | None = None
) -> DataFrame:
    """(page_id, block_no, lang) of records with no label, a wrong one or
    several languages; residue, spam, lists, tables and junk are left out."""
    crf = crf or fit_languages(df, id_col, text_col, label_col)
    held = df.sparkSession.sparkContext.broadcast((crf, residue or fit_residue(df, id_col, text_col, status_col)))

    def run(b: dict[str, list]) -> dict[str, list]:
        crf_, residue_ = held.value
        names = ("page_id", "block_no", "lang", "keys", "weights", "own", "words", "pairs")
        out: dict[str, list] = {n: [] for n in names}
        links = b.get("k") or [None] * len(b["i"])
        keep = [x for x in zip(b["i"], b["t"], b["l"], links, strict=True) if x[1]]
        for start in range(0, len(keep), 400):
            some = keep[start : start + 400]
            for (i, t, raw, ls), r in zip(some, read_languages([x[1] for x in some], crf_), strict=True):
                if r is None:
                    continue
                rows = [(n, lang) for n, lang, _, plain in r.parts if plain and lang != OTHER]
                mixed = len({lang for _, lang in rows}) > 1
                if r.whole == OTHER or not mixed and label_of(raw) == r.whole:
                    continue
                p = with_addresses(profile(t), ls)
                kinds = verdicts(p, residue_)
                if any(kinds) and kinds[1] != UNSURE:
                    continue
                terms = terms_row(pmi_terms(p.text) if kinds[1] else None)
                for n, lang in [(-1, r.whole)] + (rows if mixed else []):
                    for name, v in zip(names, (i, n, lang, *terms), strict=True):
                        out[name].append(v)
        return out

    cols = {"i": id_col, "t": text_col, "l": label_col} | ({"k": links_col} if links_col else {})
    found = map_rows(spread(pick(df, **cols)), run, f"page_id BIGINT, block_no INT, lang STRING, {TERMS}")
    found = save_point(found.withColumn("row", F.monotonically_increasing_id()))
    return found.join(low_pmi(found, df, text_col, pairs), "row", "left_anti").select("page_id", "block_no", "lang")
