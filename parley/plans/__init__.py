"""Registered queries, with the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL

MODULES = ["turn_queries", "satisfaction_queries", "table_queries", "text_queries", "series_queries", "event_queries", "learning_queries", "store_queries", "audio_queries", "dataset_queries"]

for _module in MODULES:
    import_module(f".{_module}", __name__)

__all__ = ["QUERIES", "SQL"]
