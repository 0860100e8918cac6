"""Queries of the engine, by area, with their SQL twins."""

from __future__ import annotations

from paperloom.plans import page_queries, report_queries, stream_queries, structure_queries, text_queries, timeline_queries

_AREAS = (text_queries, timeline_queries, structure_queries, page_queries, report_queries, stream_queries)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: text for area in _AREAS for name, text in area.ORACLES.items()}
