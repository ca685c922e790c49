"""All registered queries with the SQL that checks them."""

from __future__ import annotations

import importlib

from rankspark.catalog import registry

SECTIONS = (
    "sources", "records", "joins", "aggregates", "windows", "texts", "numbers",
    "retrieval", "jobs", "models", "metrics",
)


def load():
    for section in SECTIONS:
        importlib.import_module(f"rankspark.catalog.{section}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
