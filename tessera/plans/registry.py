"""All queries of the library by name and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import access, catalog, commands, events, indexes, retrieval, text

_MODULES = (retrieval, indexes, access, catalog, commands, events, text)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
