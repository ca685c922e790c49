"""Operators of a training-data pipeline: one module each, registered as ``opN_<name>`` queries."""

from __future__ import annotations

from rankspark.llm.registry import load

__all__ = ["load"]
