"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations


def queries() -> dict:
    from moraine.llm import registry

    return registry.queries()


def oracle_sql() -> dict[str, str]:
    from moraine.llm import registry

    return registry.oracle_sql()
