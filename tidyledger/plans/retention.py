"""Which stored outputs are past their retention window, and what a pass over them would do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run types in processing order, terminal statuses with the moment each was decided, the
# shared budget of one pass.
RUN_TYPES = ("cleaning", "standardization", "export")
DECIDED_AT = {"approved": "approved_at", "rejected": "rejected_at", "rolled_back": "rolled_back_at"}
BATCH_SIZE = 50


def decision_time() -> Column:
    """The moment of the decision that gave a run its present status."""
    chosen = F
    for status, column in DECIDED_AT.items():
        chosen = chosen.when(F.col("status") == status, F.col(column))
    return chosen


def eligible(runs: dict[str, DataFrame], now: str, window_days: int) -> DataFrame:
    """(artifact_type, type_rank, run_id, organization_id, output_file_path, decided_at) past the window."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    parts = [
        runs[kind]
        .where(F.col("status").isin(*DECIDED_AT) & F.col("output_deleted_at").isNull())
        .withColumn("decided_at", decision_time())
        .where(F.col("decided_at") <= cutoff)
        .select(
            F.lit(kind).alias("artifact_type"), F.lit(rank).alias("type_rank"), F.col("id").alias("run_id"),
            "organization_id", "output_file_path", "decided_at",
        )
        for rank, kind in enumerate(RUN_TYPES)
    ]
    return reduce(DataFrame.unionByName, parts)


def batch(candidates: DataFrame, size: int) -> DataFrame:
    """The shared budget: run types in order, the oldest decision first inside each."""
    return candidates.orderBy("type_rank", "decided_at", "run_id").limit(size)


def plan(chosen: DataFrame, listing: DataFrame, root: str, dry_run: bool = True) -> DataFrame:
    """Outcome of each chosen run against a file ``listing(path, size_bytes)``.

    completed (present), already_missing (not listed), failed with unsafe_path (outside the tenant's folder).
    Nothing is deleted here.
    """
    safe = F.startswith(F.col("output_file_path"), F.concat(F.lit(root + "/"), F.col("organization_id"), F.lit("/")))
    safe = safe & ~F.contains(F.col("output_file_path"), F.lit("/../"))
    files = listing.select(F.col("path").alias("output_file_path"), "size_bytes")
    return chosen.join(files, "output_file_path", "left").select(
        "artifact_type", "run_id", "organization_id",
        F.when(~safe, "failed").when(F.col("size_bytes").isNull(), "already_missing").otherwise("completed")
        .alias("outcome"),
        F.when(~safe, "unsafe_path").alias("failure_reason_code"),
        F.when(safe, F.col("size_bytes")).alias("artifact_size_bytes"),
        F.lit(dry_run).alias("dry_run"),
    )


def tallies(outcomes: DataFrame) -> DataFrame:
    """One row: the five counters of a pass and the candidates they add up to."""
    done = F.col("outcome") == "completed"
    purged = F.count_if(done & ~F.col("dry_run"))
    missing = F.count_if(F.col("outcome") == "already_missing")
    failed = F.count_if(F.col("outcome") == "failed")
    would = F.count_if(done & F.col("dry_run"))
    size = F.coalesce(F.sum(F.when(done & ~F.col("dry_run"), F.col("artifact_size_bytes"))), F.lit(0))
    return outcomes.agg(
        purged.alias("purged_count"), missing.alias("already_missing_count"), failed.alias("failed_count"),
        would.alias("dry_run_would_purge_count"), size.alias("bytes_reclaimed"),
        (purged + missing + failed + would).alias("candidates_considered"),
    )


def backlog(candidates: DataFrame, now: str) -> DataFrame:
    """One row: how many outputs are due and how old, in seconds, the oldest decision is."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.min("decided_at").cast("timestamp"))
    return candidates.agg(
        F.count(F.lit(1)).alias("backlog_count"),
        F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)).cast("double").alias("oldest_age_seconds"),
    )
