"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group above this size is carried to its rows by broadcast; at most MAX_HOT groups are, so what is
# broadcast has a fixed bound whatever the data. All other groups take the shuffle join.
HOT_ROWS = 1_000_000
MAX_HOT = 10_000


def attach_group(
    rows: DataFrame,
    groups: DataFrame,
    key: str | list[str],
    size: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """Join per-group values (one row per ``key``, with its row count ``size``) back to the group's rows.

    Rows of the largest groups never enter the shuffle; the remaining groups are small enough for one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = F.broadcast(groups.where(F.col(size) > hot_rows).orderBy(F.desc(size), *keys).limit(max_hot))
    probed = rows.join(hot, keys, "left")
    hot_part = probed.where(F.col(size).isNotNull())
    cold_part = probed.where(F.col(size).isNull()).select(*rows.columns).join(groups, keys, how)
    return hot_part.unionByName(cold_part)


def without_hot(
    rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT
) -> DataFrame:
    """Rows minus those of the largest unwanted groups, dropped before any shuffle on ``key``."""
    hot = groups.where(F.col(size) > hot_rows).orderBy(F.desc(size), key).limit(max_hot)
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti")
