"""Numbers, booleans, schedules, scores and small string rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """Digits, point and minus of a text as a double; null where they form none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def parse_boolean(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "1")


def width_descriptor(desc: Column) -> Column:
    """``300w`` is 300, ``2x`` is 1200 (600 a unit); null otherwise."""
    w = F.regexp_extract(desc, r"^([0-9]+)w+$", 1)
    x = F.regexp_extract(desc, r"^([0-9]*\.?[0-9]+)x+$", 1)
    return F.when(w != "", w.try_cast("long")).when(x != "", F.floor(x.try_cast("double") * 600))


def largest_of_srcset(srcset: Column) -> Column:
    """The widest source of a srcset, the first of equals; undescribed count as 0."""
    items = F.filter(F.transform(F.split(srcset, ","), lambda x: F.trim(x)), lambda x: x != "")
    rated = F.transform(items, lambda x, i: F.struct(F.coalesce(width_descriptor(F.regexp_extract(x, r"\s(\S+)$", 1)), F.lit(0)).alias("w"), (-i).alias("i"), F.regexp_extract(x, r"^(\S+)", 1).alias("u")))
    best = F.try_element_at(F.sort_array(rated, asc=False), F.lit(1))
    return best["u"]


# Character references that are decoded, in this order (fixed values; & first).
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&middot;", "·"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
)


def decode_entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Characters without a shape of their own (fixed values).
INVISIBLE = "​﻿‌‍⁠￾"


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def redact(key: Column) -> Column:
    return F.when(F.length(key) > 8, F.concat(F.substring(key, 1, 8), F.lit("..."))).otherwise(key)


def backoff_schedule(attempts: int, first_ms: int, factor: float, most_ms: int) -> Column:
    """Delays in ms before the second and later attempts, each from the last."""
    out, delay = [], first_ms
    for _ in range(attempts - 1):
        out.append(min(delay, most_ms))
        delay = int(delay * factor)
    return F.array(*[F.lit(x).cast("long") for x in out])


# Status of each kind of failure (fixed values).
STATUS_OF = {
    "invalid_url": 400, "invalid_request": 400, "invalid_selector": 400, "robots_disallowed": 403, "ssrf": 403, "not_found": 404, "timeout": 408,
    "empty_content": 422, "low_quality": 422, "error_page": 422, "rate_limit": 429, "internal": 500, "browser": 500, "request_failed": 502, "resource_limit": 503,
}


def status_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(500))


def is_transient(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike("timeout|timed out|connection|request"), F.lit(False))


# ---- comparison of two outputs -------------------------------------------------


def _verdict(a_wins: Column, b_wins: Column) -> Column:
    return F.when(a_wins, "a").when(b_wins, "b").otherwise("tie")


def winner_higher(a: Column, b: Column) -> Column:
    """More is better, within a tenth (one at least) a tie."""
    band = F.floor(F.greatest(F.greatest(a, b) * F.lit(0.1), F.lit(1.0)))
    return _verdict(a > b + band, b > a + band)


def winner_lower(a: Column, b: Column) -> Column:
    """Less is better, with the same band; two zeros are a tie."""
    band = F.floor(F.greatest(F.greatest(a, b) * F.lit(0.1), F.lit(1.0)))
    return F.when((a == 0) & (b == 0), "tie").otherwise(_verdict(a + band < b, b + band < a))


def winner_speed(a_ms: Column, b_ms: Column) -> Column:
    band = F.floor(F.greatest(a_ms, b_ms) * F.lit(0.2))
    return _verdict(a_ms + band < b_ms, b_ms + band < a_ms)


def winner_density(a: Column, b: Column) -> Column:
    band = F.greatest(a, b) * F.lit(0.1)
    return _verdict(a > b + band, b > a + band)


# Weight of each dimension (fixed values).
WEIGHTS = {"words": 0.5, "headings": 1.0, "links": 1.5, "images": 1.5, "code": 2.0, "cleanliness": 2.5, "density": 0.5, "metadata": 1.5, "speed": 2.0}


def advantage(winners: dict[str, Column]) -> Column:
    """Weighted advantage of the first side, from -1 to 1; ties count nothing."""
    total = sum(WEIGHTS.values())
    score = F.lit(0.0)
    for k, c in winners.items():
        score = score + F.when(c == "a", WEIGHTS[k]).when(c == "b", -WEIGHTS[k]).otherwise(0.0)
    return score / total


def overall_winner(adv: Column) -> Column:
    return F.when(adv > 0.05, "a").when(adv < -0.05, "b").otherwise("tie")


def _ladder(value: Column, steps: list[tuple[float, float]], last: float) -> Column:
    out = F.lit(last)
    for bound, score in reversed(steps):
        out = F.when(value >= bound, score).otherwise(out)
    return out


def completeness_score(success: Column, words: Column, expected: Column | int) -> Column:
    """From the ratio of words to the expected number (fixed steps)."""
    e = expected if isinstance(expected, Column) else F.lit(expected)
    ratio = words / F.greatest(e, F.lit(1)).cast("double")
    return F.when(success, _ladder(ratio, [(2.0, 10.0), (1.5, 9.0), (1.0, 8.0), (0.75, 6.0), (0.5, 4.0), (0.25, 2.0)], 1.0)).otherwise(0.0)


def speed_score(ms: Column) -> Column:
    out = F.lit(0.0)
    for bound, score in reversed([(1000, 10.0), (2000, 9.0), (3000, 8.0), (5000, 7.0), (8000, 5.0), (15000, 3.0), (30000, 1.0)]):
        out = F.when(ms <= bound, score).otherwise(out)
    return out


def markdown_quality(success: Column, words: Column, title: Column, description: Column, markdown: Column, ratio: Column, links: Column, images: Column) -> Column:
    """Score of a Markdown text from 0 to 10 (fixed amounts)."""

    def add(cond: Column, n: float) -> Column:
        return F.when(cond, n).otherwise(0.0)

    size = F.octet_length(markdown)
    tags = F.floor((F.length(markdown) - F.length(F.replace(markdown, F.lit("</"), F.lit("")))) / 2)
    dirt = tags / F.greatest(size, F.lit(1))
    few = words < 200
    score = (
        F.lit(5.0) + add(words > 500, 1.0) + add(words > 1000, 0.5) + add(title, 0.5) + add(description, 0.5)
        - F.when(dirt > 0.01, 2.0).when(dirt > 0.001, 1.0).otherwise(0.0)
        - add(markdown.contains("\n\n\n\n"), 0.5)
        - F.when((ratio < 0.05) & few, 1.5).when((ratio < 0.1) & few, 0.5).otherwise(0.0)
        + add(links > 5, 0.5) + add(markdown.contains("# "), 0.5) + add(markdown.contains("```"), 0.5) + add(images > 0, 0.5)
        + add((tags == 0) & (size > 100), 0.5)
    )
    return F.when(F.coalesce(success, F.lit(False)) & (size > 0), F.greatest(F.least(score, F.lit(10.0)), F.lit(0.0))).otherwise(0.0)


def reliability_score(success: Column) -> Column:
    return F.when(F.coalesce(success, F.lit(False)), 10.0).otherwise(0.0)


# User agents to choose from: every system with every browser.
_SYSTEMS = ("Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7", "X11; Linux x86_64")
_BROWSERS = tuple(f"AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{v}.0.0.0 Safari/537.36" for v in (119, 120)) + tuple(f"Gecko/20100101 Firefox/{v}.0" for v in (120, 121))
USER_AGENTS = tuple(f"Mozilla/5.0 ({s}) {b}" for s in _SYSTEMS for b in _BROWSERS)


def user_agent(seed: Column) -> Column:
    """One of USER_AGENTS, the same for the same seed."""
    return F.element_at(F.array(*[F.lit(a) for a in USER_AGENTS]), (F.pmod(F.crc32(seed.cast("binary")), F.lit(len(USER_AGENTS))) + 1).cast("int"))


# ---- replies of a language model -----------------------------------------------


def llm_endpoint(base: Column) -> Column:
    """(endpoint, kind) of a model's API: an address of responses or of chat
    completions stays, any other is a base of chat completions."""
    b = F.regexp_replace(base, "/+$", "")
    responses, chat = b.endswith("/responses"), b.endswith("/chat/completions")
    endpoint = F.when(responses | chat, b).otherwise(F.concat(b, F.lit("/chat/completions")))
    return F.struct(endpoint.alias("endpoint"), F.when(responses, "responses").otherwise("chat").alias("kind"))


def strip_fence(reply: Column) -> Column:
    t = F.regexp_replace(reply, r"^[ \t\r\n]*```[A-Za-z]*[ \t]*\n?", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n?[ \t]*```[ \t\r\n]*$", ""), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def judge_result(reply: Column) -> Column:
    """The result of a judge's output: of an array of events the last one of type
    result (the last of all, if there is none), of an object the object itself;
    then the text of its ``result`` field, or the object where it has none."""
    events = F.from_json(reply, "array<string>")
    kinds = F.filter(events, lambda x: F.get_json_object(x, "$.type") == "result")
    one = F.when(reply.rlike(r"^\s*\["), F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.try_element_at(events, F.lit(-1)))).otherwise(reply)
    return F.coalesce(F.get_json_object(one, "$.result"), one)


def description_of_reply(reply: Column, limit: int = 100) -> Column:
    """The description in a model's reply: a JSON field, a quoted field or the
    first line; at most ``limit`` characters."""
    t = strip_fence(reply)
    field = F.nullif(F.regexp_extract(t, r'"description"[ \t\r\n]*:[ \t\r\n]*"([^"]*)"', 1), F.lit(""))
    line = F.nullif(F.trim(F.regexp_extract(t, r"^([^\n]*)", 1)), F.lit(""))
    return F.substring(F.coalesce(field, line), 1, limit)
