"""Approve, reject and roll back runs in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_actions(runs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs after their actions, and the actions that found a status they cannot act on.

    ``runs(id, status, ...)``; ``actions(action_id, run_id, action, actor, acted_at)`` take effect in time
    order. A waiting run takes its first approve or reject, an approved one its first later rollback, so two
    minimum aggregations replace a replay of each run's history.
    """
    when = F.struct("acted_at", "action_id", "action", "actor")
    acts = actions.withColumn("when", when)
    status = runs.select(F.col("id").alias("run_id"), F.col("status").alias("before"))
    known = acts.join(status, "run_id")

    first = (
        known.where((F.col("before") == "pending_review") & F.col("action").isin("approve", "reject"))
        .groupBy("run_id")
        .agg(F.min("when").alias("first"))
    )
    staged = known.join(first, "run_id", "left")
    undo_after = (F.col("before") == "approved") | (
        (F.col("first.action") == "approve")
        & (F.struct("acted_at", "action_id") > F.struct("first.acted_at", "first.action_id"))
    )
    undo = (
        staged.where((F.col("action") == "rollback") & undo_after).groupBy("run_id").agg(F.min("when").alias("undo"))
    )

    moved = runs.join(first.withColumnRenamed("run_id", "id"), "id", "left").join(
        undo.withColumnRenamed("run_id", "id"), "id", "left"
    )
    decided = F.when(F.col("first.action") == "approve", "approved").when(F.col("first.action") == "reject", "rejected")
    updated = moved.withColumns(
        {
            "status": F.when(F.col("undo").isNotNull(), "rolled_back").otherwise(F.coalesce(decided, F.col("status"))),
            "decided_by": F.coalesce("undo.actor", "first.actor"),
            "decided_at": F.coalesce("undo.acted_at", "first.acted_at"),
        }
    ).drop("first", "undo")

    seen = (
        F.when(F.col("when") > F.col("undo"), "rolled_back")
        .when(F.col("when") > F.col("first"), decided)
        .otherwise(F.col("before"))
    )
    applied = (F.col("action_id") == F.col("first.action_id")) | (F.col("action_id") == F.col("undo.action_id"))
    conflicts = (
        staged.join(undo, "run_id", "left")
        .where(~F.coalesce(applied, F.lit(False)))
        .select(
            "action_id", "run_id", "action",
            F.concat(F.lit("Cannot "), F.col("action"), F.lit(" a run with status '"), seen, F.lit("'")).alias("detail"),
        )
    )
    return updated, conflicts
