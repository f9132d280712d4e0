"""Every query of the core by name, and its SQL."""

from __future__ import annotations

from argosift.plans.base import ORACLE, QUERIES


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)


def _load() -> None:
    from argosift.plans import evidence_queries, graph_queries, matching_queries, procedural_queries, report_queries, retrieval_queries, stats_queries, temporal_queries, text_queries, units  # noqa: F401
