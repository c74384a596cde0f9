"""Registry of queries: name -> (callable, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For work that is heavy by row: a table in fewer files than cores is dealt
    out over them; any larger table is read as it is."""
    from ..operators.arrow import spread

    return spread(table(spark, sf_dir, name))


# ---- parts of SQL twins ------------------------------------------------------------

_HEAD = "^[A-Za-z][A-Za-z0-9+.-]*://"


def sql_host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '{_HEAD}(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '')"


def sql_site(u: str) -> str:
    return f"regexp_replace({sql_host(u)}, '^www\\.', '')"


def sql_path(u: str) -> str:
    return f"CASE WHEN {sql_host(u)} IS NOT NULL THEN regexp_extract({u}, '{_HEAD}[^/?#]*([^?#]*)', 1) END"


def sql_query(u: str) -> str:
    return f"nullif(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '')"


def sql_canonical(u: str) -> str:
    p0 = f"regexp_replace({sql_path(u)}, '/+$', '')"
    p1 = f"(CASE WHEN regexp_matches({p0}, '/index\\.html$') THEN regexp_replace({p0}, '/index\\.html$', '') ELSE regexp_replace({p0}, '/index\\.php$', '') END)"
    port = f"nullif(regexp_extract({u}, '{_HEAD}(?:[^/?#@]*@)?(?:\\[[^\\]/?#]*\\]|[^/?#:]+):([0-9]+)', 1), '')"
    q = sql_query(u)
    sorted_q = f"list_reduce(list_transform(list_sort(list_transform(string_split({q}, '&'), lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'x': x}})), lambda p: p.x), lambda a, b: a || '&' || b)"
    return (
        f"CASE WHEN regexp_matches(lower({u}), '^https?://') AND {sql_host(u)} IS NOT NULL THEN 'https://' || coalesce(regexp_extract({u}, '{_HEAD}([^/?#@]*@)', 1), '') || {sql_site(u)}"
        f" || CASE WHEN {port} IS NULL OR {port} IN ('80', '443') THEN '' ELSE ':' || CAST(CAST({port} AS INTEGER) AS VARCHAR) END"
        f" || CASE WHEN {p1} = '' THEN '/' ELSE {p1} END || CASE WHEN {q} IS NULL THEN '' ELSE '?' || {sorted_q} END ELSE {u} END"
    )


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"CAST(CASE WHEN {x} IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array({x}, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')) END AS BIGINT)"


def sql_count(x: str, literal: str) -> str:
    return f"CAST(CASE WHEN {x} IS NULL THEN 0 ELSE (length({x}) - length(replace({x}, '{literal}', ''))) / {len(literal)} END AS BIGINT)"


def sql_list(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def sql_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '" + p.replace("'", "''") + "')" for p in parts) + ")"
