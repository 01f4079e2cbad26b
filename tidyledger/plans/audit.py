"""Browsing of audit logs: filter, total order, page, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sort order per log (``-`` for descending), each ending on a tie-breaker.
ORDERS = {
    "tasks": ("-created_at", "id"), "task_runs": ("-created_at", "id"), "data_sources": ("-created_at", "id"),
    "mappings": ("-created_at", "id"), "lookups": ("-created_at", "id"), "rule_sets": ("-created_at", "id"),
    "events": ("created_at", "id"),
    "changes": ("row_index", "id"), "exclusions": ("row_index", "id"),
    "groups": ("canonical_row_index", "id"),
    "decisions": ("record_a_row_index", "record_b_row_index", "id"),
    "skipped_blocks": ("blocking_key", "id"),
}


def select_rows(log: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each given column; ``None`` means the filter is not set."""
    for column, value in wanted.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log


def page(log: DataFrame, kind: str, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[kind]]
    return log.orderBy(*order).offset(offset).limit(limit)


def total(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"))
