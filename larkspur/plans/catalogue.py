"""Registry of the reference operators' queries and their SQL."""

from __future__ import annotations

from larkspur.plans import curation, documents, extra, hybrid, lifecycle, listings, phrases, publishing, ranked, recall, records, search, turns  # noqa: F401  registering is what the import is for
from larkspur.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
