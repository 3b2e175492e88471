"""Operators for training data. Nothing outside this folder imports it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("splitting", "alignment", "subjects", "confusables", "ocr", "names", "langid", "packing", "mixing", "levels")


def queries() -> dict[str, Callable]:
    """The queries of all modules of this subpackage."""
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that have one."""
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").SQL.items()}
