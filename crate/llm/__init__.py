"""Operators for large text and vector collections that feed model training."""

from __future__ import annotations

from crate.llm import registry


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
