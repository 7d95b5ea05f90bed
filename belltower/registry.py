"""All queries of the engine outside llm/, and the SQL that checks them."""

from __future__ import annotations

from belltower.plans import relational, retrieval, sequence, signals, upkeep, vector_search

FLAGSHIP = "hybrid_search"
MODULES = (vector_search, relational, sequence, retrieval, signals, upkeep)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
