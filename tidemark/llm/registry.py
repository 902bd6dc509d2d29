"""The queries of this subpackage, one per operator, and their SQL where SQL can state it."""

from __future__ import annotations

from tidemark.llm import (
    collocations,
    grid_order,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    perspectives,
    rotated_codes,
    secrets,
    token_frames,
    tournament_packing,
    toxicity,
    warc,
)

_MODULES = (warc, toxicity, token_frames, mixing, rotated_codes, perspectives, packing, ngram_join, grid_order, secrets, collocations, tournament_packing, periodic_runs)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
