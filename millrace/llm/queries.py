"""The queries of this subpackage."""

from __future__ import annotations

from millrace.llm import q_answers, q_documents, q_entries, q_results  # noqa: F401
from millrace.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
