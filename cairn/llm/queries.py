"""Queries of the problems tagged llm, with SQL where it can express them."""

from __future__ import annotations

from cairn.llm import term_queries, text_queries, vector_queries

_MODULES = (term_queries, text_queries, vector_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
