"""Every registered query of the library with its DuckDB SQL."""

from __future__ import annotations

from . import queries_docs, queries_graph, queries_ops, queries_recall, queries_search

PARTS = (queries_docs, queries_search, queries_graph, queries_ops, queries_recall)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
flagship = queries_search.flagship
