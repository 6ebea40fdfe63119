"""All queries of the core, by name, and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["problems", "catalogue", "relational", "text", "lookup", "extraction", "ingest", "sync"]


def _modules():
    for name in MODULES:
        try:
            yield import_module(f"terroir.queries.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"terroir.queries.{name}":
                raise


def registry() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE", {}).items()}
