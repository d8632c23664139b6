"""Named queries over the test tables and their DuckDB twins."""

from __future__ import annotations

from cairn.plans import points, survey


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return points.QUERIES | survey.QUERIES


def oracle_sql() -> dict:
    """Query name to DuckDB SQL."""
    return points.SQL | survey.SQL
