"""All registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from . import association, distributions, files, functions, modelling, ranking, streams, tables  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
