"""The registered queries over the test tables."""

from workload import calendars, facts, ingest, lakes, merges, planning, reports, symbols  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
