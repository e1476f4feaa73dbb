"""All queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from candela.llm import q_fingerprints, q_lexical, q_native, q_neardup, q_packing, q_pii, q_runs, q_suffix, q_text

MODULES = (q_fingerprints, q_lexical, q_native, q_neardup, q_packing, q_pii, q_runs, q_suffix, q_text)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
