"""Registered queries. Importing this package fills the registry."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("change_queries", "schema_queries", "constraint_queries", "walk_queries", "layout_queries", "ledger_queries", "data_queries", "stream_queries")

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
