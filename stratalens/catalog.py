"""Queries over the driver's tables, one for each operator, with DuckDB SQL."""

from __future__ import annotations

from stratalens.plans import finding_queries, graph_queries, path_queries, rule_cases, stream_queries  # noqa: F401
from stratalens.registry import QUERIES, SQL, Query

FLAGSHIP = "fan_in_top"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
