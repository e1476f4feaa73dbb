"""Queries over the given tables, with oracle SQL."""

from workload import q_features, q_ranking, q_ingest, q_profiling, q_postings  # noqa: F401
