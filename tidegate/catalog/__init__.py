"""All registered queries."""

from __future__ import annotations

import importlib

from tidegate.catalog.registry import ORACLE_SQL, QUERIES

MODULES = ["decisions", "tables", "eventlog", "models", "streams", "io"]


def load() -> dict:
    for module in MODULES:
        importlib.import_module(f"tidegate.catalog.{module}")
    return QUERIES
