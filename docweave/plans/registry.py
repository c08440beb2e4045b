"""All queries of the library itself, with their SQL."""

from __future__ import annotations

from . import q_metrics, q_rank, q_rules, q_store, q_text

MODULES = [q_rank, q_text, q_rules, q_store, q_metrics]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
