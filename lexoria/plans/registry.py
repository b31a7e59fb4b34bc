"""All queries of the library, by name, with the SQL each is checked against."""

from __future__ import annotations

from . import q_canonical, q_evaluation, q_index, q_ingest, q_lifecycle, q_migration, q_more, q_postrank, q_retrieval, q_runs, q_shapes, q_text, q_web

_MODULES = [q_retrieval, q_index, q_postrank, q_evaluation, q_lifecycle, q_text, q_more, q_ingest, q_canonical, q_web, q_shapes, q_migration, q_runs]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
