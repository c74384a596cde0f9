"""Problem 4: template residue and error-page text.

Method: a positive-unlabelled naive Bayes fitted by expectation-maximization.

* Trusted records need no wording of their own: an error page is a short record
  whose server answered with a status of 400 or more (a script notice, if it
  speaks of scripts or browsers), a placeholder record consists of template
  fields, a filler record of the words of the well-known filler text or of one
  or two words over and over.  A few seed phrases stand in as prior records,
  so that tiny tables have a model too.
* Records of characters that form no words are reliable content; all others are
  unlabelled and start as content.
* EM re-estimates words and priors, twice: a short unlabelled record that holds
  a passage of clear residue after the first time is trusted in the second.  The
  event model of fit and score is one: the distinct tokens of a passage, every
  token outside the vocabulary counting as the unknown token, whose share per
  kind is learned from rare words and never speaks for residue.
* Every passage (a line of the main body) is scored; the log-odds of its
  passages against content, each bounded by ``SURE`` and weighted by length,
  decide the record, so that a notice beside real content reports none.

The model is fitted on a bounded sample of records (``SAMPLE_RECORDS`` by hash of
the id and ``ERROR_RECORDS`` of those with an error status, at most
``SAMPLE_PASSAGES`` passages of each, evenly spaced); the decision covers every record and all of its passages.  Null, empty and blank texts are
never reported; repeated rows get the same verdict.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, pick, sample, spread
from .lexicon import ALL_STOP
from .lines import H1
from .profile import Profile, profile, quality_kind

KINDS = ("content", "placeholder", "filler", "error_page", "script_notice")
SAMPLE_RECORDS = 6000
ERROR_RECORDS = 2000  # with an error status
SAMPLE_PASSAGES = 20  # of one record, in the fit only
EM_ROUNDS = 5
SMOOTH = 0.01  # pseudo-counts of each kind for each word of the vocabulary, spread by the background
TRUST = 0.95  # prior of a trusted record's kind
SURE = 5.0  # log-odds beyond which a passage counts no more
ERROR_STATUS = 400
ERROR_CHARS = 200  # main body of a trusted error page, at most; a Japanese character counts as WIDE
WIDE = 3
SHORT = -2
SURE_PASSAGE = 0.99  # posterior of a passage that makes a short unlabelled record trusted in the second fit
SEED_WEIGHT = 3.0  # records that a seed phrase stands for (its words, not the prior)
PRIOR = (16.0, 1.0, 1.0, 1.0, 1.0)  # pseudo-passages of each kind

_NAMED = r"\s*=?\s*[A-Za-z_]"  # what a field begins with
FIELD = re.compile(
    rf"\{{\{{{_NAMED}[^{{}}\n]*\}}\}}|\$\{{{_NAMED}[^{{}}\n]*\}}|#\{{{_NAMED}[^{{}}\n]*\}}|<%{_NAMED}[^%\n]*%>|\{{%{_NAMED}[^%\n]*%\}}|@@{_NAMED}[\w. -]*@@|%%{_NAMED}[\w. -]*%%"
    r"|__[A-Z][A-Z_]{2,}__|\[\[[A-Z][A-Z_]{2,}\]\]|\[INSERT [A-Z ]{2,}\]|\$[A-Z][A-Z_]{2,}\$|<[A-Z]+_[A-Z_]+>|\{[a-z]+[ _.-][a-z]+\}|\[[a-z]+[ _-][a-z]+\](?!\()"
)
_CODE = re.compile(r"`[^`\n]*`")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|§\w+")
_CJK = re.compile(r"[ぁ-ヿ一-鿿]{2,}")

# The well-known filler text and its usual continuations (fixed values).
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation"
    " ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat"
    " cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus mauris egestas lectus porta".split()
)
# Words that tell a notice about scripts from other short answers of a server.
SCRIPT_CUE = re.compile(r"script|browser|cookies|loading|navigat|javascript|скрипт|браузер|スクリプト|ブラウザ|webbläsare|przeglądar|verify that you")
# Prior records of each kind (fixed values): usual wording, for tables without trusted records of the kind.
SEEDS: dict[str, tuple[str, ...]] = {
    "placeholder": ("Dear §field, your §field is ready", "by §field on §field", "§field, §field", "Only §field left", "Welcome back, §field!", "§field | §field", "§field: §field", "§field"),
    "filler": (
        "Your text goes here.", "Click here to add your own content.", "This is a sample page; edit or delete it to get started.", "Replace this paragraph with a short description of your company.",
        "Example headline for section §num.", "Caption for picture §num.", "Here goes the answer to question §num.", "Describe the benefit of feature §num in one or two sentences.",
        "Use this space to tell visitors who you are and what you do.", "Sample page", "Hello world!", "Add your title", "Section title", "Home page §num", "New page", "About (draft)",
        "§rep asdf", "§rep blah", "§rep test", "§rep xxx", "§rep foo bar", "§rep qwerty", "asdf", "qwerty", "blah", "foo bar", "xxx", "test",
    ),
    "error_page": (
        "400 Bad Request", "401 Unauthorized", "403 Forbidden", "404 Not Found", "410 Gone", "429 Too Many Requests", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
        "Page not found", "The requested address was not found on this server", "Access denied", "You don't have permission to open this resource", "Request blocked. Incident number: §hex", "Error code: §num", "Internal error",
        "Something went wrong", "Fatal error: Uncaught exception on line §num", "Traceback (most recent call last):", "Stack trace: §num", "Error establishing a database connection", "Service temporarily unavailable",
        "Down for maintenance, back in §num minutes", "Too many requests, try again in §num seconds", "No results for your search", "Your session has expired, sign in again", "This domain has expired", "Not available in your country",
        "Seite nicht gefunden", "Page introuvable", "Página no encontrada", "Página não encontrada", "Pagina non trovata", "Pagina niet gevonden", "Sidan kunde inte hittas", "Nie znaleziono strony", "Страница не найдена", "ページが見つかりません",
    ),
    "script_notice": (
        "Please enable JavaScript to view this page", "You need to enable JavaScript to run this app", "JavaScript is disabled", "This site needs scripts in order to work", "Checking your browser", "Verify that you are human",
        "Cookies and scripts are required", "Loading, please wait", "Your browser is not supported", "noscript", "Bitte aktivieren Sie JavaScript", "Veuillez activer JavaScript dans votre navigateur",
        "Debe activar JavaScript en su navegador", "Ative o JavaScript", "Attiva JavaScript per vedere questa pagina", "Schakel JavaScript in", "Aktivera JavaScript", "Włącz JavaScript", "Включите JavaScript", "スクリプトを有効にしてください。",
    ),
}
UNKNOWN = "§unk"


def tokens(passage: str) -> list[str]:
    """Words of a passage, with template fields, numbers and hexadecimal codes
    as one token each; Japanese as character pairs."""
    s = passage
    if any(c in s for c in "{[<$@%_"):
        s = FIELD.sub(" §field ", _CODE.sub(" ", s) if "`" in s else s)
    s = s.lower()
    if _HEX.search(s):
        s = _HEX.sub(" §hex ", s)
    got: list[str] = []
    for t in _TOKEN.findall(s):
        if t[0].isdigit():
            got.append(t if t in _STATUS else "§num")
        elif t[0] > "぀" and _CJK.match(t):
            got += [t[i : i + 2] for i in range(0, len(t) - 1)]
        else:
            got.append(t)
    words = [t for t in got if t[0] != "§"]
    if len(words) >= 5 and len(set(words)) <= 2:
        return ["§rep", *sorted(set(words))]
    return got


_STATUS = frozenset(("400", "401", "403", "404", "410", "429", "500", "502", "503", "504"))


def passages(p: Profile) -> list[str]:
    """Scored passages of a record: every line of its main body."""
    return [s.lstrip("# >*-+") if k != H1 else s.lstrip("# ") for s, k in zip(p.lines, p.kinds, strict=True)]


def trusted_kind(p: Profile, status: int | None) -> int:
    """Kind of a trusted record, 0 for an unlabelled one (SHORT if it is short
    enough for an error page), -1 for reliable content."""
    parts = passages(p)
    got = [tokens(s) for s in parts]
    flat = [t for ts in got for t in ts]
    if not flat:
        return 0
    fields = flat.count("§field")
    if fields and fields * 2 >= sum(t not in _LITTLE for t in flat):
        return 1
    words = [t for t in flat if t[0] != "§"]
    if sum(bool(ts) and ts[0] == "§rep" for ts in got) * 2 > len(got) or words and sum(t in FILLER_WORDS for t in words) >= 0.8 * len(words):
        return 2
    if quality_kind(p)[0] == "junk":
        return -1
    if sum(len(s) + (WIDE - 1) * sum(map(len, _CJK.findall(s))) for s in parts) > ERROR_CHARS or p.items or p.cells or p.links:
        return 0
    if status is None or status < ERROR_STATUS:
        return SHORT
    return 4 if SCRIPT_CUE.search(" ".join(parts).lower()) else 3


_LITTLE = ALL_STOP | {"§num", "written", "read", "tags", "only", "left", "dear", "ready", "welcome", "back"}


@dataclass
class Residue:
    """Fitted weights: word -> log P(word | kind) by kind."""

    weights: dict[str, tuple[float, ...]]
    prior: tuple[float, ...]

    def __post_init__(self) -> None:
        self._cache: dict[str, tuple[float, ...] | None] = {}

    def posterior(self, passage: str) -> tuple[float, ...] | None:
        """P(kind | passage), None for a passage without tokens."""
        if passage in self._cache:
            return self._cache[passage]
        if len(self._cache) > 100_000:
            self._cache.clear()
        got = self._cache[passage] = self._score(passage)
        return got

    def _score(self, passage: str) -> tuple[float, ...] | None:
        ts = dict.fromkeys(tokens(passage))
        if not ts:
            return None
        w, unknown = self.weights, self.weights[UNKNOWN]
        x = list(self.prior)
        for t in ts:
            v = w.get(t, unknown)
            for k in range(len(x)):
                x[k] += v[k]
        top = max(x)
        e = [math.exp(v - top) for v in x]
        total = sum(e)
        return tuple(v / total for v in e)

    def passage_kind(self, passage: str) -> int:
        """The likeliest kind, -1 for a passage without tokens."""
        x = self.posterior(passage)
        return -1 if x is None else x.index(max(x))

    def kind(self, p: Profile) -> str | None:
        """The record's residue kind, or None for real content."""
        size = [0.0] * len(KINDS)
        odds, total = 0.0, 0
        for s in passages(p):
            if s[:3] in ("```", "~~~"):
                continue
            x = self.posterior(s)
            if x is not None:
                n = len(s)
                total += n
                odds += n * max(-SURE, min(SURE, math.log((1.0 - x[0] + 1e-9) / (x[0] + 1e-9))))
                for k in range(1, len(KINDS)):
                    size[k] += n * x[k]
        if not total or odds <= 0:
            return None
        return KINDS[max(range(1, len(KINDS)), key=size.__getitem__)]


def fit(labelled: list[tuple[int, list[str]]]) -> Residue:
    """EM on (trusted kind, passages) pairs."""
    records: list[tuple[int, list[str]]] = [*labelled, *[(KINDS.index(k), [s]) for k, seeds in SEEDS.items() for s in seeds], (KINDS.index("filler"), [" ".join(sorted(FILLER_WORDS))])]
    docs = [(k, list(dict.fromkeys(tokens(s))), 1.0 if r < len(labelled) else SEED_WEIGHT) for r, (k, ps) in enumerate(records) for s in ps]
    docs = [d for d in docs if d[1]]
    counts: dict[str, float] = {}
    for _, ts, n in docs:
        for t in ts:
            counts[t] = counts.get(t, 0) + n
    vocab = sorted(t for t, n in counts.items() if n > 1) + [UNKNOWN]
    index = {t: i for i, t in enumerate(vocab)}
    unknown = index[UNKNOWN]
    rows = [[index.get(t, unknown) for t in ts] for _, ts, _ in docs]
    rec = np.array([r for r, (_, ps) in enumerate(records) for s in ps if tokens(s)])
    given = np.array([k for k, _, _ in docs])
    real = rec < len(labelled)
    times = np.array([n for _, _, n in docs])
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
    lengths = np.array([len(r) for r in rows])
    starts = np.cumsum(np.r_[0, lengths[:-1]])
    n, v, c = len(rows), len(vocab), len(KINDS)
    background = np.bincount(flat, weights=np.repeat(times, lengths), minlength=v) + 1.0
    background /= background.sum()

    def em(given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.where(given > 0, given, 0)
        post = np.zeros((n, c))
        post[np.arange(n), known] = 1.0
        post[given == SHORT] = 0.0  # undecided at first: they don't count
        # trusted records keep a prior of their own, unlabelled ones share the learned one, reliable content stays
        held = np.full((n, c), (1 - TRUST) / (c - 1))
        held[np.arange(n), known] = TRUST
        log_held, free, sure = np.log(held), (given == 0) | (given == SHORT), given == -1
        log_w = log_prior = np.zeros(0)
        for _ in range(EM_ROUNDS):
            wide = np.repeat(post * times[:, None], lengths, axis=0)
            prob = np.stack([np.bincount(flat, weights=wide[:, k], minlength=v) for k in range(c)], axis=1) + SMOOTH * v * background[:, None]
            log_w = np.log(prob / prob.sum(axis=0))
            log_w[unknown, 1:] = np.minimum(log_w[unknown, 1:], log_w[unknown, 0])  # an unknown word is no evidence of residue
            share = post[real].sum(axis=0) + PRIOR
            log_prior = np.log(share / share.sum())
            score = np.add.reduceat(log_w[flat], starts, axis=0) + np.where(free[:, None], log_prior, log_held)
            score -= score.max(axis=1, keepdims=True)
            e = np.exp(score)
            post = e / e.sum(axis=1, keepdims=True)
            post[sure] = (1.0, *[0.0] * (c - 1))
        return log_w, log_prior, post

    post = em(given)[2]
    # what stands beside a passage that is surely residue, in a record with room for little else, is residue too
    clear = np.zeros((len(records), c))
    np.maximum.at(clear, rec, post)
    kind = clear[:, 1:].argmax(axis=1) + 1
    more = (given == SHORT) & (clear[:, 1:].max(axis=1) >= SURE_PASSAGE)[rec]
    log_w, log_prior, _ = em(np.where(more, kind[rec], given))
    return Residue({t: tuple(map(float, log_w[i])) for t, i in index.items()}, tuple(map(float, log_prior)))


def fit_residue(df: DataFrame, id_col: str, text_col: str, status_col: str | None = None) -> Residue:
    """Fits on at most about SAMPLE_RECORDS records (``engine.sample``)."""
    cols = {"i": id_col, "t": text_col} | ({"s": status_col} if status_col else {})
    few = sample(df, SAMPLE_RECORDS, id_col, **cols).where(F.length("t") > 0)
    if status_col:  # records with an error status are rare: a sample of their own, the filter reaches the scan
        errors = sample(df.where(F.col(status_col) >= ERROR_STATUS), ERROR_RECORDS, id_col, **cols).where(F.length("t") > 0)
        few = few.where(f"s IS NULL OR s < {ERROR_STATUS}").unionAll(errors)

    def run(b: dict[str, list]) -> dict[str, list]:
        found = [profile(t) for t in b["t"]]
        parts = [passages(p) for p in found]
        few_parts = [p[:: -(-len(p) // SAMPLE_PASSAGES)] if p else [] for p in parts]
        return {"i": b["i"], "kind": [trusted_kind(p, s) for p, s in zip(found, b.get("s", [None] * len(found)), strict=True)], "parts": few_parts}

    got = map_rows(spread(few), run, "i BIGINT, kind INT, parts ARRAY<STRING>").toArrow().sort_by("i")
    return fit(list(zip(got["kind"].to_pylist(), got["parts"].to_pylist(), strict=True)))


def residue_records(df: DataFrame, id_col: str, text_col: str, status_col: str | None = None, model: Residue | None = None) -> DataFrame:
    """(page_id, kind) of the records whose main body is residue."""
    held = df.sparkSession.sparkContext.broadcast(model or fit_residue(df, id_col, text_col, status_col))

    def run(b: dict[str, list]) -> dict[str, list]:
        m = held.value
        kinds = [m.kind(profile(t)) if t else None for t in b["t"]]
        keep = [i for i, k in enumerate(kinds) if k]
        return {"page_id": [b["i"][i] for i in keep], "kind": [kinds[i] for i in keep]}

    return map_rows(spread(pick(df, i=id_col, t=text_col)), run, "page_id BIGINT, kind STRING")


def without_residue(df: DataFrame, id_col: str, text_col: str, status_col: str | None = None) -> DataFrame:
    """The rows of ``df`` whose main body is real content (null texts stay)."""
    bad = residue_records(df, id_col, text_col, status_col).select(F.col("page_id").alias("__bad"))
    return df.join(bad.distinct(), df[id_col] == F.col("__bad"), "left_anti")
