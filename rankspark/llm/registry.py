"""The queries of this subpackage and the SQL that restates those SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register a query each.
MODULES = ("line_dedup", "jaccard_join", "packing", "toxicity", "token_files", "warc", "fingerprints", "exact_topk", "url_filters",
    "sentencepiece_lattice", "vector_codes", "filter_audit", "html_text")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as a query, with its SQL where there is one."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"rankspark.llm.{module}")
    return dict(QUERIES), dict(ORACLES)
