"""Registrable domains by the public list of suffixes.

The list comes with the libraries of Spark itself, so it needs no file and no
network; it is read once a session (about nine thousand suffixes, some 150 KB)
and travels in the closure of an Arrow UDF that remembers hosts by worker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PACKAGES = ("com.google.thirdparty.publicsuffix", "org.sparkproject.guava.thirdparty.publicsuffix")
_held: dict[str, tuple[frozenset[str], frozenset[str], frozenset[str]]] = {}


def public_suffixes(spark: SparkSession) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """(suffixes, suffixes whose every child is one, exceptions to those)."""
    key = spark.sparkContext.applicationId
    if key not in _held:
        jvm = spark.sparkContext._jvm
        for package in _PACKAGES:
            try:
                c = jvm.java.lang.Class.forName(f"{package}.PublicSuffixPatterns")
            except Exception:  # the other name
                continue
            got = [frozenset(jvm.java.lang.String.join("\n", c.getField(n).get(None).keySet()).split("\n")) for n in ("EXACT", "UNDER", "EXCLUDED")]
            _held[key] = (got[0], got[1], got[2])
            break
        else:
            raise RuntimeError("the list of public suffixes isn't on the class path")
    return _held[key]


def registrable_of(host: str | None, lists: tuple[frozenset[str], frozenset[str], frozenset[str]]) -> str | None:
    """The label before the longest public suffix, with it; the host itself where
    it is a suffix, an address in numbers or a single label."""
    if not host:
        return host
    exact, under, excluded = lists
    labels = host.rstrip(".").split(".")
    if len(labels) == 1 or host[0] == "[" or all(x.isdigit() for x in labels):
        return host
    for i in range(len(labels)):
        name, parent = ".".join(labels[i:]), ".".join(labels[i + 1 :])
        if name in excluded:
            return name
        if name in exact or parent in under:
            return ".".join(labels[i - 1 :]) if i else host
    return ".".join(labels[-2:])  # an unlisted last label is a suffix


def registrable(spark: SparkSession, host: Column) -> Column:
    """Registrable part of a host in lower case; null for null."""
    lists = public_suffixes(spark)
    seen: dict[str, str] = {}

    @F.pandas_udf("string")
    def find(hosts: pd.Series) -> pd.Series:
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for h in hosts:
            if h is not None and h not in seen:
                seen[h] = registrable_of(h, lists)
            out.append(None if h is None else seen[h])
        return pd.Series(out, dtype=object)

    return find(F.lower(host))
