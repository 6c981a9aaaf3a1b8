"""Queries on the given tables that exercise every operator, with DuckDB counterparts."""

from __future__ import annotations


def _load() -> None:
    from . import columns, reports, sessions  # noqa: F401


def all_queries() -> dict:
    """Name -> callable(spark, folder)."""
    _load()
    from .tables import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    _load()
    from .tables import ORACLE

    return dict(ORACLE)
