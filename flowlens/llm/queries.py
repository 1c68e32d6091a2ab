"""All registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

from flowlens.llm import divergence, exact_dedup, jaccard_join, mixing, packing, periodic_runs, personal_data, quality_model, quality_rules, secret_scan, simhash, token_counts, warc  # noqa: F401  (registers queries)
from flowlens.llm.common import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_QUERIES", "LLM_ORACLES"]
