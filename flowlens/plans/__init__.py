"""Named queries over the driver tables and their DuckDB oracle SQL."""

from flowlens.plans import q_audit, q_flows, q_frames, q_metrics, q_models, q_profile, q_results, q_sources, q_splits, q_stream, q_views, q_windows  # noqa: F401  (registers queries)
from flowlens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
