"""Putting one-row aggregates side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row, fetched as scalar subqueries rather than joined."""
    columns = [F.col(c) for c in first.columns]
    for i, part in enumerate(others):
        first = first.withColumn(f"_part{i}", part.select(F.struct(*part.columns)).scalar())
        columns += [F.col(f"_part{i}.{c}").alias(c) for c in part.columns]
    return first.select(*columns)
