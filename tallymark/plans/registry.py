"""All queries over the evaluation tables and the SQL that checks them."""

from __future__ import annotations

from . import asr_queries, confusion_queries, devset_queries, document_queries, io_queries, matching_queries, named_queries, ranking_queries, report_queries, scalar_queries, threshold_queries, versioned_queries  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
