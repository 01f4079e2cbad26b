"""Everything that waits for a person: nine kinds of items in one queue, with search, pages and totals."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Item labels and codes per source.
PENDING = (
    ("cleaning_runs", "PROCESSING", "cleaning_run", "Cleaning Run Awaiting Review"),
    ("standardization_runs", "PROCESSING", "standardization_run", "Standardization Run Awaiting Review"),
    ("match_runs", "MATCHING", "match_run", "Match Run Awaiting Review"),
    ("export_runs", "EXPORT", "export_run", "Export Run Awaiting Review"),
)
DOWNLOAD_PARENTS = (
    ("cleaning_runs", "cleaning_run_id"),
    ("standardization_runs", "standardization_run_id"),
    ("export_runs", "export_run_id"),
)
DOWNLOAD_FAILURES = ("integrity_failed", "file_missing", "stream_failed")
COLUMNS = (
    "organization_id", "reference_id", "task_id", "task_run_id", "data_source_id", "review_category",
    "review_type", "source", "label", "confidence_score", "reason", "created_at",
)


@dataclass(frozen=True)
class Filters:
    review_category: tuple[str, ...] = ()
    review_type: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    search: str | None = None


def _text(value: str) -> Column:
    return F.lit(value)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _pending(runs: DataFrame, org: str, category: str, source: str, label: str) -> DataFrame:
    score = F.col("confidence_score") if "confidence_score" in runs.columns else _none("double")
    waiting = runs.where((F.col("organization_id") == org) & (F.col("status") == "pending_review"))
    return waiting.select(
        "organization_id", F.col("id").alias("reference_id"), "task_id", "task_run_id", "data_source_id",
        _text(category).alias("review_category"), _text("PENDING_REVIEW").alias("review_type"),
        _text(source).alias("source"), _text(label).alias("label"), score.alias("confidence_score"),
        _none("string").alias("reason"), "created_at",
    )


def _ambiguous(decisions: DataFrame, runs: DataFrame, org: str) -> DataFrame:
    open_pairs = decisions.where((F.col("organization_id") == org) & (F.col("decision") == "ambiguous"))
    mine = runs.where(F.col("organization_id") == org)
    parents = mine.select(F.col("id").alias("match_run_id"), "task_id", "task_run_id", "data_source_id")
    return open_pairs.join(parents, "match_run_id").select(
        "organization_id", F.col("id").alias("reference_id"), "task_id", "task_run_id", "data_source_id",
        _text("MATCHING").alias("review_category"), _text("AMBIGUOUS").alias("review_type"),
        _text("match_decision").alias("source"), _text("Ambiguous Match Decision").alias("label"),
        "confidence_score", "reason", "created_at",
    )


def _failed(task_runs: DataFrame, tasks: DataFrame, org: str) -> DataFrame:
    failed = task_runs.where((F.col("organization_id") == org) & (F.col("status") == "failed"))
    owners = tasks.select(F.col("id").alias("task_id"), "data_source_id")
    return failed.join(owners, "task_id").select(
        "organization_id", F.col("id").alias("reference_id"), "task_id", F.col("id").alias("task_run_id"),
        "data_source_id", _text("SYSTEM").alias("review_category"), _text("FAILED").alias("review_type"),
        _text("task_run").alias("source"), _text("Failed Processing Run").alias("label"),
        _none("double").alias("confidence_score"), F.col("error_message").alias("reason"), "created_at",
    )


def _downloads(events: DataFrame, tables: dict[str, DataFrame], org: str) -> DataFrame:
    """Failed downloads with the run they belong to: one scan of the events, whichever of the keys they carry."""
    broken = F.col("outcome") == "integrity_failed"
    failed = events.where((F.col("organization_id") == org) & F.col("outcome").isin(*DOWNLOAD_FAILURES))
    keys = F.array(*[
        F.struct(F.lit(t).alias("_table"), F.col(key).alias("_parent")) for t, key in DOWNLOAD_PARENTS
    ])
    carried = F.inline(F.filter(keys, lambda k: k["_parent"].isNotNull()))
    spread = failed.select("organization_id", "id", "outcome", "failure_reason_code", "created_at", carried)
    parents = reduce(
        DataFrame.unionByName,
        [
            tables[t].where(F.col("organization_id") == org).select(
                F.lit(t).alias("_table"), F.col("id").alias("_parent"), "task_id", "task_run_id", "data_source_id"
            )
            for t, _ in DOWNLOAD_PARENTS
        ],
    )
    return spread.join(parents, ["_table", "_parent"]).select(
        "organization_id", F.col("id").alias("reference_id"), "task_id", "task_run_id", "data_source_id",
        _text("DOWNLOAD").alias("review_category"),
        F.when(broken, "INTEGRITY_FAILURE").otherwise("FAILED").alias("review_type"),
        _text("artifact_download_event").alias("source"),
        F.when(broken, "Artifact Integrity Verification Failed").otherwise("Artifact Delivery Failed").alias("label"),
        _none("double").alias("confidence_score"), F.col("failure_reason_code").alias("reason"), "created_at",
    )


def queue(tables: dict[str, DataFrame], organization_id: str) -> DataFrame:
    """The unfiltered queue of one tenant. The tenant predicate leads every branch and prunes partitions."""
    org = organization_id
    branches = [_pending(tables[t], org, category, source, label) for t, category, source, label in PENDING]
    branches.append(_ambiguous(tables["match_decisions"], tables["match_runs"], org))
    branches.append(_failed(tables["task_runs"], tables["tasks"], org))
    branches.append(_downloads(tables["artifact_download_events"], tables, org))
    return reduce(DataFrame.unionByName, branches)


def _as_uuid(term: str) -> str | None:
    try:
        return str(uuid.UUID(term))
    except ValueError:
        return None


def filtered(tables: dict[str, DataFrame], organization_id: str, filters: Filters = Filters()) -> DataFrame:
    """The queue under its filters. Names are joined in only when a text is searched for."""
    items = queue(tables, organization_id)
    for column in ("review_category", "review_type", "source"):
        wanted = getattr(filters, column)
        if wanted:
            items = items.where(F.col(column).isin(*wanted))
    term = (filters.search or "").strip()
    if not term:
        return items
    as_uuid = _as_uuid(term)
    if as_uuid is not None:
        return items.where((F.col("task_id") == as_uuid) | (F.col("reference_id") == as_uuid))
    # Wildcards of the term stay live; a backslash is an ordinary character.
    like = f"%{term.lower()}%".replace("\\", "\\\\")
    tasks = tables["tasks"].select(F.col("id").alias("task_id"), F.lower("name").alias("_task"))
    sources = tables["data_sources"].select(F.col("id").alias("data_source_id"), F.lower("name").alias("_source"))
    named = items.join(tasks, "task_id", "left").join(sources, "data_source_id", "left")
    return named.where(F.col("_task").like(like) | F.col("_source").like(like)).select(*COLUMNS)


def page(items: DataFrame, sort: str = "created_at", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order: ties end on the reference id."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    first = F.asc_nulls_last("confidence_score") if sort == "confidence_score" else F.asc("created_at")
    return items.orderBy(first, "reference_id").offset(offset).limit(limit)


def summary(items: DataFrame) -> DataFrame:
    """Five counters over the filtered queue, folded from one small group-by."""
    kinds = items.groupBy("review_category", "review_type").agg(F.count(F.lit(1)).alias("n"))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    category, kind = F.col("review_category"), F.col("review_type")
    return kinds.agg(
        count(F.lit(True)).alias("total_items"),
        count(kind == "PENDING_REVIEW").alias("pending_reviews"),
        count(kind == "AMBIGUOUS").alias("ambiguous_matches"),
        count((category == "SYSTEM") & (kind == "FAILED")).alias("failed_runs"),
        count(category == "DOWNLOAD").alias("download_failures"),
    )
