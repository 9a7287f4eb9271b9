"""The catalogue of queries: each with its Spark plan and its SQL."""

from __future__ import annotations

from . import flows, nested, routes, state, wire  # noqa: F401
from .catalogue import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
