"""The registered queries, with SQL for the same rows."""

from __future__ import annotations

from importlib import import_module

from codeloom.plans import base

MODULES = ("memory_queries", "text_queries", "project_queries", "stream_queries", "coding_queries", "format_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"codeloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
