"""Every query of the package outside ``llm``, with its SQL."""

from __future__ import annotations

from . import aggregate_queries, evidence_queries, full_queries, gate_queries, join_queries, ledger_queries, mention_queries, ranking_queries, recovery_queries, script_queries, sequence_queries, similarity_queries, stream_queries, text_queries, whole_queries  # noqa: F401  importing registers
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
