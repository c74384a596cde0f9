"""Problem 1: page boilerplate mixed with main content.

``boilerplate_lines`` names every line outside the main body, ``main_text``
gives the body alone.  Method: two-pass block rules (see ``lines``).  Nulls,
empty texts and texts without any visible line give no row and a null body;
repeated rows are judged each on its own; very long texts are read whole.
No shuffle: one pass over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .engine import map_rows, pick, spread
from .lines import html_kinds, main_body, main_flags, markdown_kinds

SCHEMA = "field STRING, row_id BIGINT, line_no INT"


def _flags(text: str, is_html: bool) -> list[bool | None]:
    return main_flags((html_kinds if is_html else markdown_kinds)(text)[1])


def boilerplate_lines(df: DataFrame, id_col: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """``fields``: output label -> (column, is it HTML).  One row per line that
    shows text and doesn't belong to the main body."""
    names = {f"t{i}": c for i, (c, _) in enumerate(fields.values())}
    marks = [(f"t{i}", label, is_html) for i, (label, (_, is_html)) in enumerate(fields.items())]

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"field": [], "row_id": [], "line_no": []}
        for name, label, is_html in marks:
            for row_id, text in zip(b["row_id"], b[name], strict=True):
                if text:
                    bad = [i for i, f in enumerate(_flags(text, is_html)) if f is False]
                    out["line_no"] += bad
                    out["row_id"] += [row_id] * len(bad)
                    out["field"] += [label] * len(bad)
        return out

    return map_rows(spread(pick(df, row_id=id_col, **names)), run, SCHEMA)


def main_text(df: DataFrame, id_col: str, text_col: str, is_html: bool = False) -> DataFrame:
    """(row_id, body): the main body's lines, joined by newlines; null where
    the text is null or has no main line."""

    def run(b: dict[str, list]) -> dict[str, list]:
        body = []
        for text in b["t"]:
            if not text:
                body.append(None)
                continue
            if is_html:
                lines, flags = text.split("\n"), _flags(text, True)
            else:
                lines, _, flags = main_body(text)
            keep = [x.rstrip("\r") for x, f in zip(lines, flags, strict=True) if f]
            body.append("\n".join(keep) if keep else None)
        return {"row_id": b["row_id"], "body": body}

    return map_rows(spread(pick(df, row_id=id_col, t=text_col)), run, "row_id BIGINT, body STRING")
