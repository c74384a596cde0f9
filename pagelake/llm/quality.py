"""Problem 7: per-document text quality statistics.

``quality_statistics`` gives one row per record with counts and ratios of its
whole text (Catalyst columns over the array of its words, no Python) and the
published rules it fails.  ``quality_found`` measures the main body, applies the
fixed thresholds of ``profile.QUALITY_RULES`` to the columns of measures of a
batch (NumPy) and names the records that are no prose (list, table, junk), or
whose stated word count is wrong, each with the reason recorded.  Null texts
have null statistics and no finding, empty texts zero counts and no finding.
No shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import map_rows, pick, spread
from .lexicon import ALL_STOP
from .profile import MEASURES, QUALITY_RULES, Measures, Profile, measures, profile, quality_kind
from .residue import Residue, fit_residue
from .spam import UNSURE, spam_kind, with_addresses

_SYMBOL = r"#|\.\.\.|…|[{}\\<>|~^]"
_BULLET = r"^\s*(?:[-*+•]|\d{1,3}[.)])\s"
_ENDS = r"[.!?。！？…:;][\"'”’»)*_]*\s*$"
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # white space as in the definition of a word
_EDGES = r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$"
STATS = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "bullet_lines", "common_words")
# Published fixed thresholds for web text: (reason, fails).
RULES = (
    ("words<50", "words < 50"),
    ("words>100000", "words > 100000"),
    ("mean_word_length<3", "mean_word_length < 3"),
    ("mean_word_length>10", "mean_word_length > 10"),
    ("symbol_ratio>0.1", "symbol_ratio > 0.1"),
    ("bullet_lines>0.9", "bullet_lines > 0.9"),
    ("common_words<0.05", "common_words < 0.05"),
)


def text_statistics(text: Column) -> dict[str, Column]:
    """Words, mean word length, symbols per word, share of lines that end in
    punctuation, share of bullet lines and share of common words, as columns."""
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, _SPACE, "") != "")
    n, rows = F.size(words).cast("long"), F.size(lines)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(text.isNotNull(), F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6))

    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    common = F.size(F.filter(words, lambda w: F.lower(F.regexp_replace(w, _EDGES, "")).isin(sorted(ALL_STOP))))
    return {
        "words": F.when(text.isNotNull(), n),
        "mean_word_length": ratio(letters, n),
        "symbol_ratio": ratio(F.regexp_count(text, F.lit(_SYMBOL)), n),
        "punctuated_lines": ratio(F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(_ENDS)))), rows),
        "bullet_lines": ratio(F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(_BULLET)))), rows),
        "common_words": ratio(common, n),
    }


def quality_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, STATS, reasons): the published rules that each record fails."""
    got = df.select(F.col(id_col).alias("row_id"), *[c.alias(n) for n, c in text_statistics(F.col(text_col)).items()])
    failed = F.filter(F.array(*[F.when(F.expr(fails), F.lit(name)) for name, fails in RULES]), lambda x: x.isNotNull())
    return got.withColumn("reasons", F.when(F.col("words").isNotNull(), failed))


def verdicts(p: Profile, residue: Residue) -> tuple[str | None, str | None, str | None]:
    """(residue kind, spam kind, quality kind), at most one of them set, but for
    the spam kind UNSURE: a body of no quality kind that the mean PMI decides."""
    r = residue.kind(p)
    if r:
        return r, None, None
    s = spam_kind(p)
    return None, s, None if s and s != UNSURE else quality_kind(p)[0]


def quality_found(df: DataFrame, id_col: str, text_col: str, count_col: str, status_col: str | None = None, links_col: str | None = None, residue: Residue | None = None) -> DataFrame:
    """(page_id, kind, reason): list, table or junk for records that no residue or spam
    verdict covers, and word_count where the stated count isn't the number of
    white-space-separated words."""
    held = df.sparkSession.sparkContext.broadcast(residue or fit_residue(df, id_col, text_col, status_col))

    def run(b: dict[str, list]) -> dict[str, list]:
        model = held.value
        ids, kinds, reasons = [], [], []
        links = b.get("l") or [None] * len(b["i"])
        some = [(i, t, n, with_addresses(profile(t), ls)) for i, t, n, ls in zip(b["i"], b["t"], b["n"], links, strict=True) if t]
        m = Measures(*np.array([measures(p) for *_, p in some], dtype=float).reshape(-1, len(MEASURES)).T)
        left = m.rows > 0
        for kind, reason, fails in QUALITY_RULES:
            hit = left & fails(m)
            left &= ~hit
            for k in np.flatnonzero(hit).tolist():
                if verdicts(some[k][3], model)[2] == kind:  # no residue, no spam
                    ids.append(some[k][0])
                    kinds.append(kind)
                    reasons.append(reason)
        for i, t, n, _ in some:
            if n is not None and n != len(t.split()):
                ids.append(i)
                kinds.append("word_count")
                reasons.append("stated!=counted")
        return {"page_id": ids, "kind": kinds, "reason": reasons}

    cols = {"i": id_col, "t": text_col, "n": count_col} | ({"l": links_col} if links_col else {})
    return map_rows(spread(pick(df, **cols)), run, "page_id BIGINT, kind STRING, reason STRING")
