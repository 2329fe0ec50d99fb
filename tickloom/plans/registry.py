"""All registered queries and their SQL texts."""

from __future__ import annotations

from tickloom.plans import export_queries, frame_queries, metric_queries, stream_queries

_PARTS = [metric_queries, frame_queries, export_queries, stream_queries]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
