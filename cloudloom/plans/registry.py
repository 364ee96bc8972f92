"""All registered queries of the library and their SQL."""

from __future__ import annotations

from cloudloom.plans import event_queries  # noqa: F401  its queries are registered as it is imported
from cloudloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
