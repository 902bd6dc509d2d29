"""Queries over the test tables, with the SQL that states the same rows."""

from __future__ import annotations

from tidemark.plans import bar_queries, ledger_queries, signal_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (bar_queries, signal_queries, ledger_queries, stream_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
