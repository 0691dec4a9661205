"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    from tessera.llm import registry

    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    from tessera.llm import registry

    return dict(registry.ORACLES)
