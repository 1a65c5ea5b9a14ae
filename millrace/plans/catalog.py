"""All queries outside ``millrace.llm``."""

from __future__ import annotations

from millrace.plans import answers, checks, quality, ranges, results, sets, tables, texts  # noqa: F401
from millrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
