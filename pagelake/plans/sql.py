"""Operators as SQL functions of a session."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import render
from ..operators.robots import is_allowed


def register(spark: SparkSession) -> list[str]:
    """Registers html_to_markdown(html, url), html_metadata_json(html, url),
    css_extract(html, selectors_json), robots_allowed(content, path, agent) and
    pagination_links(html, url); all take whole columns in Arrow batches."""

    @F.pandas_udf("string")
    def html_to_markdown(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([render.to_markdown(h, u or "") for h, u in zip(html, url, strict=True)], dtype="object")

    @F.pandas_udf("string")
    def html_metadata_json(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(render.metadata(h, u), ensure_ascii=False) for h, u in zip(html, url, strict=True)], dtype="object")

    @F.pandas_udf("string")
    def css_extract(html: pd.Series, selectors: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(render.extract(h, json.loads(s)), ensure_ascii=False) if s else None for h, s in zip(html, selectors, strict=True)], dtype="object")

    @F.pandas_udf("boolean")
    def robots_allowed(content: pd.Series, path: pd.Series, agent: pd.Series) -> pd.Series:
        return pd.Series([is_allowed(c, p or "/", a or "*") for c, p, a in zip(content, path, agent, strict=True)])

    @F.pandas_udf("array<string>")
    def pagination_links(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([render.pagination_links(h, u) if h and u else [] for h, u in zip(html, url, strict=True)])

    functions = {f.__name__: f for f in (html_to_markdown, html_metadata_json, css_extract, robots_allowed, pagination_links)}
    for name, fn in functions.items():
        spark.udf.register(name, fn)
    return sorted(functions)
