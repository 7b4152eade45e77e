"""All registered queries of the reference's operators, with their SQL."""

from __future__ import annotations

from quillon.operators import ann, cards, conversations, evaluation, frameworks, freshness, graph, imports, metrics, naming, relational, retrieval, services, signals, topology
from quillon.sources import files, ruby, scripts, transcripts
from quillon.streaming import changes

MODULES = (metrics, relational, retrieval, ann, graph, imports, freshness, conversations, evaluation, cards, services, signals, topology, naming, frameworks, files, ruby, scripts, transcripts, changes)


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
