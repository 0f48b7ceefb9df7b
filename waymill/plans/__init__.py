"""Registered queries with their SQL."""

from waymill.plans import graphs, ingests, places, reports, rooms, scalars, timing, verdicts  # noqa: F401
from waymill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
