"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\r\n\f]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(words(text))).cast("long")


def reading_time(text: Column) -> Column:
    """Minutes at 200 words a minute, rounded up; 0 for no words."""
    return F.ceil(word_count(text) / 200).cast("long")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def excerpt(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters: all, up to the last sentence end, or up to
    the last space with an ellipsis; null for no text."""
    t = trim_all(text)
    head = F.substring(t, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(sentence != "", sentence).when(word != "", F.concat(word, F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(t) > 0, F.when(F.length(t) <= limit, t).otherwise(cut))


def normalised_content(text: Column) -> Column:
    """Content for exact duplicate search: lines trimmed, runs of blank lines
    capped, outer space off."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", ""))
    return trim_all(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    """Hash of the normalised content; null stays null."""
    return F.sha2(normalised_content(text), 256)


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def looks_like_navigation(text: Column) -> Column:
    low = F.lower(text)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    start = low.startswith("skip to") | low.startswith("menu") | low.startswith("search")
    return F.coalesce(start | ((F.octet_length(text) < 150) & (breaks > 5)), F.lit(False))


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(text.isNull(), F.lit(0)).otherwise((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def count_lines(text: Column, pattern: str) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(lines(text), lambda x: x.rlike(pattern)))).cast("long")


def table_count(markdown: Column) -> Column:
    """Runs of lines that start with a pipe, outside fenced code."""
    zero = F.struct(F.lit(False).alias("fence"), F.lit(False).alias("row"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        s = F.ltrim(line)
        mark = s.startswith("```")
        fence = F.when(mark, ~acc["fence"]).otherwise(acc["fence"])
        row = ~mark & ~fence & s.startswith("|")
        return F.struct(fence.alias("fence"), row.alias("row"), (acc["n"] + F.when(row & ~acc["row"], 1).otherwise(0)).alias("n"))

    return F.when(markdown.isNull(), F.lit(0)).otherwise(F.aggregate(lines(markdown), zero, step, lambda a: a["n"])).cast("long")


def objective_metrics(markdown: Column) -> dict[str, Column]:
    """Counts that tell how much structure a Markdown text holds."""
    n = word_count(markdown)
    size = F.coalesce(F.octet_length(markdown), F.lit(0))
    return {
        "word_count": n,
        "markdown_length": size.cast("long"),
        "heading_count": count_lines(markdown, r"^[ \t]*#{1,6} "),
        "code_block_count": F.floor(count_of(markdown, "```") / 2).cast("long"),
        "html_artifact_count": count_of(markdown, "</"),
        "empty_link_count": count_of(F.replace(markdown, F.lit("![]("), F.lit("")), "[]("),
        "base64_count": count_of(markdown, "data:image/") + count_of(markdown, "data:application/"),
        "list_count": count_lines(markdown, r"^[ \t]*(?:[-*+] |[0-9].*[.)] )"),
        "content_density": F.coalesce(F.try_divide(n.cast("double"), size / F.lit(1024.0)), F.lit(0.0)),
        "content_hash": F.sha2(markdown, 256),
    }


def judge_excerpt(markdown: Column, limit: int) -> Column:
    """Three quarters from the head and one from the tail of a long text."""
    head, tail = limit * 3 // 4, limit // 4
    note = F.lit("\n\n[...]\n\n")
    return F.when(F.length(markdown) <= limit, markdown).otherwise(F.concat(F.substring(markdown, 1, head), note, F.right(markdown, F.lit(tail))))
