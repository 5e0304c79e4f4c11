"""Registry of the named queries and their SQL oracles."""

from __future__ import annotations

from . import metric_queries, model_queries, segment_queries, sequence_queries, vector_queries

MODULES = (segment_queries, sequence_queries, vector_queries, model_queries, metric_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
