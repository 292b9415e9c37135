"""Queries of the library's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from evidentia.plans import evidence, expressions, graphs, knowledge, models, relational, symptoms, texts  # noqa: F401
from evidentia.plans.registry import ORACLES, QUERIES

FLAGSHIP = "symptoms_all"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
