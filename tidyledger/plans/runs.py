"""Read-only reports over task runs, their events and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Retry delays, attempts, timeout, histogram bounds, batch sizes.
RETRY_BASE_SECONDS, RETRY_CAP_SECONDS = 30, 900
DEFAULT_MAX_ATTEMPTS = 3
DURATION_BOUNDS = (0.1, 0.5, 1, 5, 15, 30, 60, 120, 300, 600, 1800)
CLAIM_BATCH, SCHEDULE_BATCH = 5, 50
EVENT_COUNTERS = {"claimed": "claimed", "succeeded": "completed", "failed": "failed", "requeued": "retried"}


def _at(now: str):
    return F.lit(now).cast("timestamp")


def _first(rows: DataFrame, order: tuple[str, ...], limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def due_schedules(
    tasks: DataFrame, now: str, limit: int | None = None, skip: DataFrame | None = None
) -> DataFrame:
    """Active scheduled tasks whose time has come, with the time they run next; the oldest ``limit`` if one is given.

    Missed periods fold into one: the next time counts from ``now``. ``skip(id)`` leaves tasks out of a pass.
    """
    due = tasks.where(
        F.col("schedule_interval_seconds").isNotNull() & F.col("is_active") & (F.col("next_run_at") <= _at(now))
    )
    if skip is not None:
        due = due.join(skip.select("id"), "id", "left_anti")
    after = _at(now) + F.make_dt_interval(secs=F.col("schedule_interval_seconds"))
    return _first(due.withColumn("following_run_at", after), ("next_run_at", "id"), limit)


def claimable_runs(runs: DataFrame, tasks: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """Pending runs past their retry time, with their task's timeout; the oldest ``limit`` if one is given."""
    ready = runs.where(
        (F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= _at(now)))
    )
    timeouts = tasks.select(F.col("id").alias("task_id"), "timeout_seconds")
    return _first(ready.join(timeouts, "task_id"), ("created_at", "id"), limit)


def stuck_runs(runs: DataFrame, now: str) -> DataFrame:
    """Running, but the lease ran out."""
    return runs.where((F.col("status") == "running") & (F.col("lease_expires_at") < _at(now)))


def retry_plan(attempts: DataFrame) -> DataFrame:
    """Failed attempts (attempt_count, retryable, max_attempts): whether and after how long each is retried."""
    limit = F.coalesce("max_attempts", F.lit(DEFAULT_MAX_ATTEMPTS))
    again = F.col("retryable") & (F.col("attempt_count") < limit)
    delay = F.least(F.lit(RETRY_BASE_SECONDS) * F.pow(F.lit(2.0), F.col("attempt_count") - 1), F.lit(RETRY_CAP_SECONDS))
    return attempts.withColumns({"will_retry": again, "delay_seconds": F.when(again, delay.cast("long"))})


def event_counters(events: DataFrame) -> DataFrame:
    """(counter, value) for claimed, completed, failed and retried runs."""
    counted = events.where(F.col("event_type").isin(*EVENT_COUNTERS)).groupBy("event_type").count()
    name = F.lit(None).cast("string")
    for event, counter in EVENT_COUNTERS.items():
        name = F.when(F.col("event_type") == event, F.lit(counter)).otherwise(name)
    return counted.select(name.alias("counter"), F.col("count").alias("value"))


def duration_histogram(durations: DataFrame, column: str = "duration_seconds") -> DataFrame:
    """(le, value): cumulative counts per bound, then +Inf, in one pass without a shuffle of rows."""
    value = F.col(column)
    bounds = [(str(float(b)), F.count_if(value <= b)) for b in DURATION_BOUNDS]
    bounds.append(("+Inf", F.count(value)))
    one = durations.agg(*[c.alias(f"b{i}") for i, (_, c) in enumerate(bounds)])
    rows = [F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("value")) for i, (le, _) in enumerate(bounds)]
    return one.select(F.inline(F.array(*rows)))


def queue_depth(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "pending").alias("queue_depth"))
