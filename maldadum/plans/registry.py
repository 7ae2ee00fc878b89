"""All queries of the core, by name."""

from __future__ import annotations

from maldadum.plans import group_queries, label_queries, mining_queries, pipeline_queries, problems, ranking_queries, text_queries

MODULES = (problems, mining_queries, label_queries, text_queries, ranking_queries, pipeline_queries, group_queries)
FLAGSHIP = "p4_pairs"


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
