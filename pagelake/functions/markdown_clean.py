"""Markdown clean-up as Catalyst expressions, in a fixed order.

Patterns stay in the subset that Java and RE2 share; lines end at \\n only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import strip_invisible
from .text import trim_all

# Whole lines of interface wording (fixed values).
UI_NOISE = (
    "Ask about this section|Copy for LLM|View as Markdown|Copy as Markdown",
    r"Was this (?:section |page )?helpful\s*(?:to you)?\??",
    "(?:Share|Tweet|Pin it|Email)",
    "(?:Table of [Cc]ontents|In this article|On this page)",
    "Show more|Read more|Load more|See all|Expand all|Collapse all",
    "Scroll to top|Back to top",
    "Primary navigation",
    r"Loading\.\.\.",
    "Sponsored",
    "Notifications",
    "Shop by category",
    "All Categories",
    "Toggle the table of contents",
    r"move to sidebar\s*hide",
    r"\d+\s+languages?",
    "Edit links?",
    "Edit this page on GitHub",
    r"Was this page helpful\s*(?:to you)?\??\s*(?:Yes|No)?",
    "Suggest (?:changes|edits?)",
    "Report (?:an? )?(?:issue|bug)",
)
_M = "(?m)(?d)"  # Java: only \n ends a line


def setext_to_atx(md: Column) -> Column:
    md = F.regexp_replace(md, _M + r"^([^\n]+)\n={3,}[ \t]*$", "# $1")
    return F.regexp_replace(md, _M + r"^([^\n|#>*+\-][^\n]*)\n-{3,}[ \t]*$", "## $1")


def trailing_hashes(md: Column) -> Column:
    return F.regexp_replace(md, _M + r"^(#{1,6}[ \t]+[^\n]+?)[ \t]+#+[ \t]*$", "$1")


def trim_lines(md: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(md, _M + r"[ \t\r\f]+$", ""), "\n{4,}", "\n\n\n"))


def drop_base64_images(md: Column) -> Column:
    return F.regexp_replace(md, r"(!\[[^\]]*\])\(data:[^)]*\)", "$1(data:image-removed)")


def drop_empty_links(md: Column) -> Column:
    return F.regexp_replace(md, r"(^|[^!])\[[ \t]*\]\([^)]*\)", "$1")


def drop_empty_bullets(md: Column) -> Column:
    return F.regexp_replace(md, r"(?:\n[ \t]*[-*+][ \t]*){3,}(\n|$)", "\n")


def drop_ui_noise(md: Column) -> Column:
    return F.regexp_replace(md, _M + r"^[ \t]*(?:" + "|".join(UI_NOISE) + r")[ \t]*$", "")


def drop_edit_links(md: Column) -> Column:
    return F.regexp_replace(md, r"[ \t\n]*\[\[edit\]\([^)]*\)\]", "")


def lift_headings(md: Column) -> Column:
    """A heading inside a link's text becomes a heading that holds the link."""
    return F.regexp_replace(md, r"\[[ \t]*(#{1,6})[ \t]+([^\]#]+?)[ \t]*#*[ \t]*\]\(([^)]*)\)", "$1 [$2]($3)")


def drop_leaked_scripts(md: Column) -> Column:
    """Lines of script that a declaration, an assignment or a call gives away."""
    for p in (
        r"^[ \t]*(?:var|let|const)[ \t]+[\w\\]+[ \t]*=[^\n]*$",
        r"^[ \t]*[\w\\]+(?:\.[\w\\]+|\[['\"][^'\"\n]*['\"]\])[ \t]*=[ \t]*[^\n]*;[ \t]*$",
        r"^[ \t]*[\w\\]+(?:\.[\w\\]+)*\([^)\n]*\)[ \t]*;[ \t]*$",
    ):
        md = F.regexp_replace(md, _M + p, "")
    return md


def drop_copyright(md: Column) -> Column:
    return F.regexp_replace(md, _M + r"^[ \t]*Copyright[ \t]+©[^\n]*$", "")


def squeeze_link_text(md: Column) -> Column:
    md = F.regexp_replace(md, r"\[\s{2,}([^\]]*?)\s{2,}\]\(", "[$1](")
    for _ in range(3):
        md = F.regexp_replace(md, r"\[([^\]]*?)\s{2,}([^\]]*?)\]\(", "[$1 $2](")
    return md


def drop_skip_links(md: Column) -> Column:
    """Links for assistive technology at the start of a line."""
    p = r"(?i)^[ \t]*\[(?:(?:Skip|Jump|Go) to [^\]]*|Skip (?:navigation|nav)|Back to (?:Top|Main|Content)|Screen reader only[^\]]*)\]\([^)]*\)[ \t]*\n?"
    return F.regexp_replace(F.regexp_replace(md, _M + p, ""), _M + p, "")


def compress_tables(md: Column) -> Column:
    """Cells of table rows with one space on either side, rules as ``---``."""

    def cell(c: Column) -> Column:
        t = F.trim(F.translate(c, "\t", " "))
        colon = F.when(t.startswith(":") & t.endswith(":") & (F.length(t) > 1), " :---: ").when(t.endswith(":"), " ---: ").when(t.startswith(":"), " :--- ").otherwise(" --- ")
        return F.when(t == "", "").when(t.rlike(r"^[-: ]+$"), colon).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))

    def row(x: Column) -> Column:
        t = F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
        return F.when(t.startswith("|") & t.endswith("|") & (F.length(t) > 1), F.array_join(F.transform(F.split(t, r"\|"), cell), "|")).otherwise(x)

    return F.array_join(F.transform(F.split(md, "\n"), row), "\n")


def title_if_bare(md: Column, title: Column) -> Column:
    """Puts the title on top of a text without any heading."""
    bare = ~md.rlike(_M + r"^[ \t]*#")
    return F.when(bare & (F.trim(title) != ""), F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), md)).otherwise(md)


def cap_size(md: Column, limit: int = 500_000) -> Column:
    """Cuts at the last line end within ``limit`` characters and says so."""
    head = F.regexp_extract(F.substring(md, 1, limit), r"(?s)^(.*)\n", 1)
    return F.when(F.length(md) <= limit, md).otherwise(F.concat(head, F.lit("\n\n[Content truncated]")))


STEPS = (
    strip_invisible, setext_to_atx, trailing_hashes, trim_lines, drop_base64_images, drop_empty_links, drop_empty_bullets, drop_ui_noise, drop_edit_links, lift_headings,
    drop_leaked_scripts, drop_copyright, squeeze_link_text, drop_skip_links,
)


def clean(md: Column) -> Column:
    """All steps in their order, then at most one blank line in a row."""
    for step in STEPS:
        md = step(md)
    return F.regexp_replace(md, "\n{3,}", "\n\n")
