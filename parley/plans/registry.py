"""All queries of the analytics library by name, and their DuckDB SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in ("vector_queries", "text_queries", "segment_queries", "more_queries", "phrase_queries", "pipeline_queries", "topic_queries"):
    _module = importlib.import_module(f".{_m}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
