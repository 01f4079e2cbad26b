"""Order-dependent plan shapes that stay distributed.

A global sort-and-limit, a global ``row_number`` or a window over one hot key all end in a single task.
Each helper here first reduces the problem to a small table: quantiles of the index or counts of its ranges, whose
number does not depend on how dense the index is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.session import ensure_checkpoint_dir

# Rows per index bucket: bounds what one window task holds.
BUCKET_ROWS = 1_000_000
# Shares of the rows among which a cut is chosen, and the accuracy of their quantiles: ranks are wrong by one part in
# ACCURACY of all rows at most.
ACCURACY = 10_000
SHARES = tuple(2.0**-n for n in range(12, -1, -1))


def bucket_of(index: str, bucket_rows: int = BUCKET_ROWS) -> Column:
    return F.expr(f"{index} div {bucket_rows}")


def offsets(counts: DataFrame, order: Sequence[str], count: str = "count") -> DataFrame:
    """Running start of each counted piece. One row per file or bucket comes in, so one task is enough."""
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_start", F.sum(count).over(running) - F.col(count))


def first_rows(
    rows: DataFrame, index: str, limit: int | None, then: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The first ``limit`` rows by ``index`` and the ``then`` columns.

    A plain ORDER BY with LIMIT n gathers up to n rows of every task in one task. Here the index's quantiles, one small
    sketch a task, give a value that at least ``limit`` rows do not exceed, and only rows up to it are sorted: at most
    about twice the limit and some thousandths of all rows. ``bucket_rows`` is not used any more.
    """
    if limit is None:
        return rows
    shares = F.array(*map(F.lit, SHARES))
    told = rows.agg(
        F.count(F.lit(1)).alias("_n"), F.max(index).alias("_most"),
        F.percentile_approx(index, shares, ACCURACY).alias("_values"),
    )
    pairs = F.zip_with("_values", shares, lambda value, share: F.struct(value.alias("value"), share.alias("share")))
    enough = F.filter(pairs, lambda p: (p["share"] - 2 / ACCURACY) * F.col("_n") >= limit)
    cut = told.select(F.coalesce(F.get(enough, F.lit(0))["value"], F.col("_most")))
    kept = rows.where(F.col(index) <= cut.scalar())
    return kept.orderBy(index, *then).limit(limit)


def number_rows(rows: DataFrame, index: str, output: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense 0-based position by a unique ``index``: rows of the ranges before, plus the place inside the range.

    Ranges come from sampled quantiles, so each task has about as many rows, dense index or not. Rows are stored once
    in their ranges: numbers of a range never change after it was counted. ``bucket_rows`` is not used any more.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(index).sortWithinPartitions(index).select(
        "*", F.spark_partition_id().alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_rank")
    ).checkpoint()
    starts = offsets(dealt.groupBy("_range").count(), ["_range"]).select("_range", "_start")
    # One row per partition of a shuffle.
    return (
        dealt.join(F.broadcast(starts), "_range")
        .withColumn(output, F.col("_start") + F.col("_rank"))
        .drop("_range", "_rank", "_start")
    )


def next_in_group(
    rows: DataFrame, group: str, index: str, output: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The next higher ``index`` of the same ``group``, null at its end.

    The window runs per (group, index bucket), so a group holding a third of the table is spread over
    its buckets; the seams are bridged through one row per (group, bucket).
    """
    placed = rows.withColumn("_bucket", bucket_of(index, bucket_rows))
    inside = Window.partitionBy(group, "_bucket").orderBy(index)
    linked = placed.withColumn(output, F.lead(index).over(inside))
    heads = placed.groupBy(group, "_bucket").agg(F.min(index).alias("_head"))
    seams = heads.withColumn(
        "_next", F.lead("_head").over(Window.partitionBy(group).orderBy("_bucket"))
    ).select(group, "_bucket", "_next")
    return (
        linked.join(seams, [group, "_bucket"], "left")
        .withColumn(output, F.coalesce(F.col(output), F.col("_next")))
        .drop("_bucket", "_next")
    )
