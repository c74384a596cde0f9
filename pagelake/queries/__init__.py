"""Query catalogue over the test tables, with SQL twins."""

from . import data_q, extra_q, more_q, pages_q, urls_q  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
