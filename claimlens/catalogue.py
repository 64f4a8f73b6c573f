"""All queries of the library, with their SQL."""

from __future__ import annotations

from .plans import claim_queries, layout_queries, log_queries, metric_queries, repo_queries, verdict_queries  # noqa: F401
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
