"""Table rules as data expectations: each yields the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATUS = "status IN ('pending_review', 'approved', 'rejected', 'rolled_back')"
_SCORE = "confidence_score BETWEEN 0 AND 1"
_ONE_RUN = (
    "(CASE WHEN cleaning_run_id IS NOT NULL THEN 1 ELSE 0 END)"
    " + (CASE WHEN standardization_run_id IS NOT NULL THEN 1 ELSE 0 END)"
    " + (CASE WHEN export_run_id IS NOT NULL THEN 1 ELSE 0 END) = 1"
)
_FINISHED = "(outcome = 'started') = (completed_at IS NULL)"

# What every row of a table must satisfy.
CHECKS = {
    "cleaning_runs": {
        "status_known": _STATUS,
        "counts_not_negative": "row_count >= 0 AND total_changes_count >= 0 AND duplicate_row_count >= 0",
        "confidence_range": _SCORE,
    },
    "standardization_runs": {
        "status_known": _STATUS,
        "counts_not_negative": "row_count >= 0 AND total_changes_count >= 0",
        "confidence_range": _SCORE,
    },
    "match_runs": {"status_known": _STATUS, "counts_not_negative": "row_count >= 0", "confidence_range": _SCORE},
    "match_decisions": {
        "pair_order": "record_a_row_index < record_b_row_index",
        "score_range": "total_score BETWEEN 0 AND 1 AND threshold_used BETWEEN 0 AND 1",
        "confidence_range": _SCORE,
        "decision_known": "decision IN ('duplicate', 'ambiguous')",
    },
    "match_groups": {"record_count_min": "record_count >= 2"},
    "match_skipped_blocks": {"block_size_positive": "block_size > 0"},
    "match_rule_fields": {"weight_positive": "weight > 0"},
    "standardization_changes": {"row_index_not_negative": "row_index >= 0"},
    "match_rule_sets": {
        "threshold_order": "0 <= review_threshold AND review_threshold < duplicate_threshold"
        " AND duplicate_threshold <= 1",
        "version_min": "version >= 1",
    },
    "export_runs": {
        "status_known": _STATUS,
        "rows_within_source": "row_count >= 0 AND row_count <= source_row_count",
        "excluded_consistent": "excluded_row_count = source_row_count - row_count",
        "column_count_min": "output_column_count >= 1",
        "format_version_min": "csv_format_version >= 1",
    },
    "artifact_download_events": {
        "one_run_reference": _ONE_RUN,
        "outcome_known": "outcome IN ('started', 'completed', 'integrity_failed', 'file_missing',"
        " 'stream_failed', 'purged')",
        "reason_matches_outcome": "(outcome IN ('integrity_failed', 'file_missing', 'stream_failed'))"
        " = (failure_reason_code IS NOT NULL)",
        "completed_matches_outcome": _FINISHED,
        "bytes_not_negative": "bytes_served >= 0",
    },
    "artifact_retention_events": {
        "one_run_reference": _ONE_RUN,
        "outcome_known": "outcome IN ('started', 'completed', 'already_missing', 'failed')",
        "reason_matches_outcome": "(outcome = 'failed') = (failure_reason_code IS NOT NULL)",
        "completed_matches_outcome": _FINISHED,
        "size_not_negative": "artifact_size_bytes IS NULL OR artifact_size_bytes >= 0",
    },
    "task_runs": {
        "status_invariants": "(status = 'pending' AND started_at IS NULL AND finished_at IS NULL AND error_message IS NULL)"
        " OR (status = 'running' AND started_at IS NOT NULL AND finished_at IS NULL)"
        " OR (status = 'success' AND started_at IS NOT NULL AND finished_at IS NOT NULL AND error_message IS NULL)"
        " OR (status = 'failed' AND started_at IS NOT NULL AND finished_at IS NOT NULL AND error_message IS NOT NULL)",
        "finished_after_started": "finished_at IS NULL OR started_at IS NULL OR finished_at >= started_at",
        "lease_only_while_running": "(status = 'running') = (lease_token IS NOT NULL)"
        " AND (lease_token IS NULL) = (lease_expires_at IS NULL)",
    },
    "tasks": {
        "interval_floor": "schedule_interval_seconds IS NULL OR schedule_interval_seconds >= 30",
        "schedule_pair": "(schedule_interval_seconds IS NULL) = (next_run_at IS NULL)",
    },
}
# Columns that must be unique together (active rows only where the table can be deactivated).
UNIQUE = {
    "cleaning_runs": ("task_run_id",),
    "standardization_runs": ("task_run_id",),
    "match_runs": ("task_run_id",),
    "export_runs": ("task_run_id",),
    "match_rule_fields": ("rule_set_id", "column_name"),
    "match_rule_sets": ("organization_id", "data_source_id"),
}


def violations(table: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """(table_name, expectation, key) of every broken row check; a null result of a check is no violation.

    All checks of a table run in one pass: each row names the checks it breaks.
    """
    broken = F.array(
        *[F.when(~F.expr(rule), F.lit(name)) for name, rule in CHECKS[table].items()]
    )
    return rows.select(
        F.lit(table).alias("table_name"), F.explode(broken).alias("expectation"), F.col(key).cast("string").alias("key")
    ).where("expectation IS NOT NULL")


def duplicates(table: str, rows: DataFrame) -> DataFrame:
    """(table_name, expectation, key) of values that must be unique but are not. Null is a scope of its own."""
    columns = UNIQUE[table]
    live = rows.where("is_active") if "is_active" in rows.columns else rows
    name = "unique_" + "_".join(columns)
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return (
        live.groupBy(*columns).count().where("count > 1")
        .select(F.lit(table).alias("table_name"), F.lit(name).alias("expectation"), key.alias("key"))
    )


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Every violation of every known table among ``tables``."""
    parts = [violations(t, rows) for t, rows in tables.items() if t in CHECKS]
    parts += [duplicates(t, rows) for t, rows in tables.items() if t in UNIQUE]
    return reduce(DataFrame.unionByName, parts)
