"""Problem 10: text cut off by field limits.

Method: the length of every text is recomputed as a field might have held it
(characters, UTF-8 bytes, UTF-16 units, with HTML or JSON escaping, with
\\r\\n line ends); grouped by source and measure, lengths that far more texts
have than their neighbours are hidden storage limits.  Then the ending is
inspected: closed (a complete sentence, entry, row, code block, address or
closing mark), open (inside code, a row or link, or inside a sentence of a text
that closes its sentences otherwise), marked (an ellipsis or "more" put where
something is missing), plain (could be either: a list entry, a title, a line of
a text that never closes one) or form (an address, signature or code, which
seldom ends a cut).

The verdict gives its reason.  ``limit``: the text stands at a limit of its
source and isn't closed (a form only if its last word is unknown).  ``declared``:
more bytes were declared than came, and it isn't closed.  ``ending``: neither,
but it is open, marked after an unfinished phrase, or plain with a last word
unknown to the corpus (counted exactly, against a bar that grows with the
corpus).  ``marks``: marked where many marks of its source stand.

Null, empty and blank texts are never reported.  A copy is judged like its
original.  Counts cover all rows and are pre-aggregated by source, measure and
length, so a source that holds a third of all rows needs no large task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .engine import map_rows, pick, save_point, spread
from .lexicon import ALL_STOP

MEASURES = ("chars", "utf8", "utf16", "html_chars", "html_utf8", "json_chars", "json_utf8", "json_ascii", "crlf_chars", "crlf_utf8")
SLACK = (0, 3, 1, 5, 6, 1, 4, 5, 1, 4)  # units that a cut may leave unused (a split character or escape)
NEAR = 30  # lengths on either side that a limit is compared with
LEAST = 6  # different texts at a limit, at least,
SHARE = 0.01  # and this share of the source's different texts
TIMES = 8.0  # times the mean of its neighbours
MARK_WINDOW = 14  # characters below a limit within which marked cuts fall
KNOWN_SHARE = 1e-6  # a word is known if this share of the texts has it, and one text at least
_FLUSH = 200_000

_TERMINAL = ".!?。！？"
_TERMINALS = tuple(_TERMINAL)
_SENTENCE_END = re.compile(r"[.!?][\"'”’»)*_]*\s+\S|[。！？]\S")
_CLOSERS = "\"'”’»)]}*_`>」』"
_ABBREVIATION = re.compile(r"(?:^|[\s(\"“])(?:e\.g|i\.e|dr|mr|mrs|ms|st|prof|vs|cf|z\.b|d\.h|bzw|p\.ex|np|bijv|t\.ex|т\.е)\.$", re.I)
_MARK = re.compile(r"(?:\s?(?:…|\.\.\.)|\s*\[(?:…|\.\.\.)\]|\s*\((?:more|continued|\.\.\.|…)\)|\s+(?:read more|continue reading)(?:…|\.\.\.)?)$", re.I)
_SURE_MARK = re.compile(r"(?:\[(?:…|\.\.\.)\]|\((?:more|\.\.\.|…)\)|\s(?:…|\.\.\.)|read more|continue reading)$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_LINK_END = re.compile(r"!?\[[^\]\n]*\]\([^)\s]+\)[.!?]?$")
_OPEN_LINK = re.compile(r"\[[^\]\n]*(?:\](?:\([^)\n]*)?)?$")
_URL_END = re.compile(r"(?:https?://|www\.)[^\s)\]]+$")
_RULE = re.compile(r"^\s*(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,}|#+\s*)$")
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"^\s*(?:[—–]|--)\s*\S")
_GREETING = re.compile(r"^(?:thanks|regards|best|best wishes|kind regards|sincerely|cheers|yours|love|grüße|viele grüße|cordialement|saludos|saluti|groeten|hälsningar|pozdrawiam|abraços|с уважением)[,!]?$", re.I)
_CODE_LINE = re.compile(r"^(?:v|tel|fax|isbn|ref|no)\.?\s?[\d .:/-]+$|^v\d+(?:\.\d+)+$", re.I)
_KEY_VALUE = re.compile(r"^[^\W\d_][^.!?:]{0,24}: \S[^.!?]{0,40}(?<![,;:])$")

CLOSED, OPEN, MARKED, SURE, PLAIN, FORM = range(6)


def ending(text: str) -> int:
    """How a text ends (see the module's description)."""
    s = text.rstrip()
    if not s:
        return CLOSED
    start = s.rfind("\n")
    line = s[start + 1 :].strip()
    # code
    if "```" in s or "~~~" in s:
        fence = ""
        for x in s.split("\n"):
            m = x.lstrip()[:3]
            if m in ("```", "~~~"):
                fence = "" if fence == m else fence or m
        if fence:
            return OPEN
        if line[:3] in ("```", "~~~"):
            return CLOSED
    if s[-1] == "�":
        return OPEN
    if _RULE.match(line):
        return CLOSED
    before = s[:start].rstrip("\r") if start >= 0 else ""
    alone = start < 0 or before.endswith("\n") or not before
    if line[0] == "|":
        if not line.endswith("|"):
            return OPEN
        up = before.rsplit("\n", 1)[-1].strip()
        return CLOSED if not up.startswith("|") or up.count("|") == line.count("|") else OPEN
    if _MARK.search(line):
        if _SURE_MARK.search(line):
            return SURE
        words = _WORD.findall(_MARK.sub("", line).lower())
        if words and words[-1] in ALL_STOP and words[-1] not in ("on", "out", "so", "o", "up"):
            return SURE
        if re.search(r"[.!?。！？]\s+\S", _MARK.sub("", line)) or re.search(r"[。！？]\S", _MARK.sub("", line)):
            return SURE  # sentences before an unfinished one
        if line.count("`") % 2 or _MARK.sub("", line)[-1:] in (",", ";", ":", "-", "–"):
            return SURE
        return MARKED
    if line[0] == "#" and line.lstrip("#")[:1] == " ":
        return OPEN if before.strip() else CLOSED  # a heading leads to nothing
    core = line.rstrip(_CLOSERS)
    item = bool(_ITEM.match(line))
    if core and core[-1] in _TERMINAL:
        if _ABBREVIATION.search(core) and core == line:
            return OPEN
        return CLOSED
    if _LINK_END.search(line):
        return CLOSED
    if "[" in line and _OPEN_LINK.search(line) and not line.endswith("]") and not item:
        return OPEN
    if _URL_END.search(line):
        return FORM if " " not in line else OPEN
    if line[-1] in ")]}»”」』" and alone and line[0] in "([{«“「『":
        return CLOSED
    if item:
        body = _ITEM.sub("", line)
        if len(body.split()) > 5 or len(body) > 48:  # a sentence as an entry, if others end as such
            return OPEN if closes_sentences(before, line, True) else PLAIN
        return PLAIN
    if _SIGN.match(line) or _CODE_LINE.match(line):
        return FORM
    words = line.split()
    if alone and len(words) <= 4 and line.isupper():
        return CLOSED
    up = before.rsplit("\n", 1)[-1].strip()
    if not alone and _GREETING.match(up) and len(words) <= 3:
        return FORM
    if alone and len(words) <= 6 and _KEY_VALUE.match(line):
        return FORM
    return OPEN if line[-1] in ",;-–" or closes_sentences(before, line, False) else PLAIN


def closes_sentences(before: str, line: str, item: bool) -> bool:
    """Whether a text closes its sentences: one in its last line, or the greater
    part of its other lines of several words (of its entries, for an entry)."""
    if _SENTENCE_END.search(line):
        return True
    closed = loose = 0
    for x in before.split("\n"):
        x = x.strip()
        if not x or x[0] in "#|" or x[:3] in ("```", "~~~") or bool(_ITEM.match(x)) != item or _LINK_END.search(x):
            continue
        if x.rstrip(_CLOSERS)[-1:] in _TERMINALS:
            closed += 1
        elif len(x.split()) > 5 and x[0] not in " \t":
            loose += 1
    return closed > loose or not item and closed > 0 and closed == loose


def last_word(text: str) -> str:
    size = 80
    while True:
        found = None
        for found in _WORD.finditer(text[-size:]):
            pass
        if size >= len(text) or found is not None and found.start() > 0:
            return found.group().lower() if found is not None else ""
        size *= 4  # no word, or one that may begin before


def lengths(t: str) -> list[int]:
    """The ten measures of a text, in the order of MEASURES."""
    n = len(t)
    if t.isascii():
        b = u = n
        wide = 0
    else:
        b = len(t.encode("utf-8", "surrogatepass"))
        u = len(t.encode("utf-16-le", "surrogatepass")) // 2
        wide = n - len(t.encode("ascii", "ignore"))
    escapes = 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * t.count('"') + 4 * t.count("'")
    js = t.count('"') + t.count("\\") + t.count("\n") + t.count("\r") + t.count("\t")
    bare = t.count("\n") - t.count("\r\n")
    return [n, b, u, n + escapes, b + escapes, n + js, b + js, n + js + 5 * wide + 6 * (u - n), n + bare, b + bare]


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(w, n): texts that hold a word other than as their last, which may be cut
    itself.  Every partition sums its words before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            words = list(held)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["w", "n"])
            held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(set(_WORD.findall(t.lower())[:-1]))
                    if len(held) > _FLUSH:
                        yield from flush()
        yield from flush()

    return spread(pick(df, t=text_col).where("length(t) > 0")).mapInArrow(run, "w STRING, n BIGINT").groupBy("w").agg(F.sum("n").alias("n"))


def hidden_limits(found: DataFrame) -> DataFrame:
    """(source, measure, len, n): lengths at which far more different texts of a
    source lie than around them.  ``found``: source, h (hash of the text) and m
    (the measures) per text; copies count once."""
    once = found.groupBy("source", "h").agg(F.first("m").alias("m"))
    counts = once.select("source", F.posexplode("m").alias("measure", "len")).groupBy("source", "measure", "len").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("source", "measure")
    near = whole.orderBy("len").rangeBetween(-NEAR, NEAR)
    counts = counts.withColumn("around", (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * NEAR)).withColumn("all", F.sum("n").over(whole))
    many = (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all")) & (F.col("n") >= TIMES * (F.col("around") + F.lit(0.1)))
    return counts.where(many).drop("around", "all")


ENDS = "doc_id BIGINT, source STRING, h BIGINT, e INT, w STRING, bytes BIGINT, declared BIGINT, m ARRAY<BIGINT>"


def text_endings(df: DataFrame, id_col: str, text_col: str, source_col: str, declared_col: str | None) -> DataFrame:
    """Ending and measures of every text that isn't blank; its last word, if the
    ending is plain or a form."""
    cols = {"i": id_col, "t": text_col, "s": source_col} | ({"d": declared_col} if declared_col else {})

    def run(b: dict[str, list]) -> dict[str, list]:
        keep = [k for k, t in enumerate(b["t"]) if t and not t.isspace()]
        texts = [b["t"][k] for k in keep]
        sizes = [lengths(t) for t in texts]
        ends = [ending(t) for t in texts]
        return {
            "doc_id": [b["i"][k] for k in keep],
            "source": [b["s"][k] for k in keep],
            "h": [crc32(x) << 31 ^ crc32(x[::-1]) for x in (t.encode("utf-8", "surrogatepass") for t in texts)],
            "e": ends,
            "w": [last_word(t) if e in (PLAIN, FORM) else None for t, e in zip(texts, ends, strict=True)],
            "bytes": [x[1] for x in sizes],
            "declared": [b["d"][k] for k in keep] if "d" in b else [None] * len(keep),
            "m": sizes,
        }

    return map_rows(spread(pick(df, **cols)), run, ENDS)


def truncated(df: DataFrame, id_col: str, text_col: str, source_col: str, declared_col: str | None = None) -> DataFrame:
    """(doc_id, source, ending, at_limit, reason, cut) of every text that isn't blank."""
    ends = save_point(text_endings(df, id_col, text_col, source_col, declared_col))
    limits = hidden_limits(ends)
    bar = max(1, math.ceil(KNOWN_SHARE * ends.count()))
    asked = ends.where("w IS NOT NULL").select("w").distinct()
    known = word_counts(df, text_col).where(F.col("n") >= bar).join(asked, "w", "left_semi").select("w", F.lit(True).alias("known"))
    asking = ends.where("w IS NOT NULL").join(known, "w", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    judged = ends.where("w IS NULL").withColumn("known", F.lit(True)).unionByName(asking)
    slack = F.element_at(F.array(*[F.lit(x) for x in SLACK]), F.col("measure") + 1)
    per_source = limits.groupBy("source").agg(F.collect_list(F.struct("measure", "len", slack.alias("slack"))).alias("limits"))
    # texts that end in a mark: how many of their source end in one at about the same length
    marked = ends.where(F.col("e").isin(MARKED, SURE)).select("source", (F.element_at("m", 1) / F.lit(MARK_WINDOW)).cast("int").alias("bin"))
    bins = marked.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    dense = bins.withColumn("all", F.sum("n").over(Window.partitionBy("source"))).where((F.col("n") >= 3) & (F.col("n") >= 0.12 * F.col("all")))
    dense = dense.groupBy("source").agg(F.collect_set("bin").alias("bins"))
    out = judged.join(per_source, "source", "left").join(dense, "source", "left")
    at_limit = F.exists("limits", lambda x: (F.get("m", x.measure) <= x.len) & (F.get("m", x.measure) >= x.len - x.slack))
    at_limit = F.coalesce(at_limit, F.lit(False))
    b = (F.element_at("m", 1) / F.lit(MARK_WINDOW)).cast("int")
    in_bins = F.coalesce(F.array_contains("bins", b), F.lit(False))
    short = F.coalesce(F.col("declared") > F.col("bytes") * 1.02 + 8, F.lit(False))
    e, known = F.col("e"), F.col("known")
    unfinished = e.isin(OPEN, SURE, PLAIN, MARKED)
    reason = (
        F.when(at_limit & (unfinished | (e == FORM) & ~known), "limit")
        .when(short & e.isin(OPEN, SURE, PLAIN, FORM), "declared")
        .when(e.isin(OPEN, SURE) | (e == PLAIN) & ~known, "ending")
        .when((e == MARKED) & in_bins, "marks")
    )
    name = F.element_at(F.array(*[F.lit(x) for x in ("closed", "open", "marked", "cut mark", "plain", "form")]), F.col("e") + 1)
    return out.select("doc_id", "source", name.alias("ending"), at_limit.alias("at_limit"), reason.alias("reason"), reason.isNotNull().alias("cut"))


def truncation_rates(verdicts: DataFrame) -> DataFrame:
    """Texts, cut texts and rate by source."""
    return verdicts.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut_texts"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate")
    )
