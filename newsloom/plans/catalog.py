"""All queries of the news engine by name, with their SQL twins."""

from __future__ import annotations

from . import changes, feeds, health, job_log, lifecycle, over_time, publishing, reading, texts  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
