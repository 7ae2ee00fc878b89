"""All queries of this subpackage, by name."""

from __future__ import annotations

from maldadum.llm import queries_tables, queries_texts

MODULES = (queries_tables, queries_texts)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
