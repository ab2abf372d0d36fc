"""All registered queries by name, and the SQL that an oracle runs beside each."""

from __future__ import annotations

from quillrank.plans import collections, extraction, flows, latency, reports, relational, resumes, scoring, textual, uploads  # noqa: F401
from quillrank.plans.base import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES", "query", "table"]
