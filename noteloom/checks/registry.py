"""All registered queries. Results use session time zone UTC for timestamp arithmetic."""

from __future__ import annotations

import importlib

_MODULES = ("notes_checks", "search_checks", "log_checks", "index_checks", "plan_checks")


def _modules():
    return [importlib.import_module(f"noteloom.checks.{m}") for m in _MODULES]


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
