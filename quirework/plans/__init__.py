"""Named queries over a data folder, and their SQL."""

from __future__ import annotations

from quirework.plans import documents, gazette, relations, texts, vectors

_MODULES = (texts, relations, documents, vectors, gazette)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
