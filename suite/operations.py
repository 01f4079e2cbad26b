"""Review queue, approvals, lineage, retention, schedules, metrics and expectations over derived run tables.

Each run table is derived from all rows of a driver table by the expressions below, shared with the check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from suite.base import load, query
from tidyledger.functions.jsonscan import secret_keys
from tidyledger.operators import expect
from tidyledger.plans import audit, config_tables, lineage, paging, retention, review_actions, review_queue, runs
from tidyledger.session import ensure_checkpoint_dir

NOW = "2000-06-01 00:00:00"
O, C, L, E = "o_orderkey", "c_custkey", "l_orderkey", "event_id"


def _status(key: str) -> str:
    return (
        f"CASE WHEN {key} % 20 < 3 THEN 'pending_review' WHEN {key} % 20 < 17 THEN 'approved'"
        f" WHEN {key} % 20 < 19 THEN 'rejected' ELSE 'rolled_back' END"
    )


def _run(prefix: str, more: str = "") -> str:
    """Columns all run tables share, one run per order."""
    when = "o_orderdate"
    return (
        f"'{prefix}' || CAST({O} AS STRING) AS id, 'org' || CAST(o_custkey % 3 AS STRING) AS organization_id,"
        f" 't' || CAST(o_custkey % 50 AS STRING) AS task_id, '{prefix}r' || CAST({O} AS STRING) AS task_run_id,"
        f" 'd' || CAST(o_custkey % 25 AS STRING) AS data_source_id, {_status(O)} AS status,"
        f" CAST({when} AS STRING) AS created_at,"
        f" CASE WHEN {O} % 20 >= 3 AND ({O} % 20 < 17 OR {O} % 20 = 19) THEN {when} + INTERVAL 1 DAY END AS approved_at,"
        f" CASE WHEN {O} % 20 IN (17, 18) THEN {when} + INTERVAL 2 DAY END AS rejected_at,"
        f" CASE WHEN {O} % 20 = 19 THEN {when} + INTERVAL 3 DAY END AS rolled_back_at,"
        f" CASE WHEN {O} % 7 = 0 THEN {when} + INTERVAL 9 DAY END AS output_deleted_at,"
        f" CASE WHEN {O} % 29 = 0 THEN '/elsewhere/x.csv' ELSE '/out/org' || CAST(o_custkey % 3 AS STRING) || '/{prefix}'"
        f" || CAST({O} AS STRING) || '.csv' END AS output_file_path{more}"
    )


_SCORE = f", {O} % 101 / CAST(100 AS DOUBLE) AS confidence_score"
_COUNTS = f", {O} % 1000 AS row_count, {O} % 17 - 1 AS total_changes_count, {O} % 5 AS duplicate_row_count"
SQL = {
    "cleaning_runs": f"SELECT {_run('c', _SCORE + _COUNTS)} FROM orders",
    "standardization_runs": f"SELECT {_run('s', _SCORE + _COUNTS)} FROM orders",
    "match_runs": f"SELECT {_run('m', _SCORE + _COUNTS)} FROM orders",
    "export_runs": "SELECT "
    + _run(
        "e",
        f", {O} % 900 AS source_row_count, {O} % 901 AS row_count, {O} % 900 - {O} % 901 AS excluded_row_count,"
        f" {O} % 40 AS output_column_count, 1 AS csv_format_version",
    )
    + " FROM orders",
    "match_decisions": f"SELECT 'k' || CAST({L} AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||"
    f" CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id,"
    f" 'org' || CAST(o_custkey % 3 AS STRING) AS organization_id, 'm' || CAST({L} AS STRING) AS match_run_id,"
    " l_partkey AS record_a_row_index, l_suppkey AS record_b_row_index, l_discount AS total_score,"
    " l_quantity / CAST(50 AS DOUBLE) AS threshold_used, l_discount AS confidence_score,"
    " CASE l_returnflag WHEN 'R' THEN 'ambiguous' ELSE 'duplicate' END AS decision,"
    " 'score of line ' || CAST(l_linenumber AS STRING) AS reason, CAST(l_shipdate AS STRING) AS created_at"
    f" FROM lineitem JOIN orders ON {L} = {O}",
    "tasks": "SELECT 't' || CAST(c_custkey AS STRING) AS id, 'org' || CAST(c_custkey % 3 AS STRING) AS organization_id,"
    " 'd' || CAST(c_nationkey AS STRING) AS data_source_id, 'Load ' || lower(c_mktsegment) AS name,"
    " CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 ELSE NULL END AS schedule_interval_seconds,"
    f" CASE WHEN c_custkey % 3 = 0 OR c_custkey % 31 = 0 THEN CAST('{NOW}' AS TIMESTAMP)"
    " + CAST(c_custkey % 11 - 5 AS INT) * INTERVAL 1 DAY END AS next_run_at,"
    " c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 4 = 0 THEN 600 END AS timeout_seconds,"
    " CAST(c_custkey AS STRING) AS created_at FROM customer",
    "data_sources": "SELECT 'd' || CAST(n_nationkey AS STRING) AS id, n_name AS name FROM nation",
    "task_runs": f"SELECT 'x' || CAST({E} AS STRING) AS id, 'org' || CAST(user_id % 3 AS STRING) AS organization_id,"
    " 't' || CAST(user_id % 50 AS STRING) AS task_id,"
    " CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'success' END AS status,"
    " CASE event_type WHEN 'error' THEN 'failure ' || CAST(user_id AS STRING) END AS error_message,"
    " CASE WHEN event_type <> 'view' THEN ts END AS started_at,"
    " CASE WHEN event_type NOT IN ('view', 'click') THEN ts + INTERVAL 1 HOUR END AS finished_at,"
    f" CASE WHEN event_type = 'click' AND {E} % 13 <> 0 THEN 'lease' END AS lease_token,"
    f" CASE WHEN event_type = 'click' AND {E} % 13 <> 0 THEN ts + INTERVAL 2 HOUR END AS lease_expires_at,"
    f" CASE WHEN {E} % 3 = 0 THEN ts + INTERVAL 1 DAY END AS next_retry_at,"
    f" {E} % 4 + 1 AS attempt_count, {E} % 3 <> 0 AS retryable,"
    f" CASE WHEN {E} % 2 = 0 THEN {E} % 6 + 1 END AS max_attempts, value AS duration_seconds,"
    " CAST(ts AS STRING) AS created_at FROM events",
    "artifact_download_events": f"SELECT 'a' || CAST({O} AS STRING) AS id,"
    " 'org' || CAST(o_custkey % 3 AS STRING) AS organization_id,"
    f" CASE o_orderpriority WHEN '1-URGENT' THEN 'c' || CAST({O} AS STRING) END AS cleaning_run_id,"
    f" CASE o_orderpriority WHEN '2-HIGH' THEN 's' || CAST({O} AS STRING) END AS standardization_run_id,"
    f" CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'e' || CAST({O} AS STRING) END AS export_run_id,"
    f" CASE WHEN {O} % 10 < 7 THEN 'completed' WHEN {O} % 10 = 7 THEN 'integrity_failed' WHEN {O} % 10 = 8 THEN"
    " 'file_missing' ELSE CASE o_orderstatus WHEN 'P' THEN 'started' ELSE 'stream_failed' END END AS outcome,"
    f" CASE WHEN {O} % 10 = 7 THEN 'hash_mismatch' WHEN {O} % 10 = 8 THEN 'file_not_found' END AS failure_reason_code,"
    f" CASE WHEN {O} % 10 < 9 THEN o_orderdate END AS completed_at, {O} % 50 - 1 AS bytes_served,"
    " CAST(o_orderdate AS STRING) AS created_at FROM orders",
}
_SOURCES = ("orders", "customer", "lineitem", "nation", "events")
CTES = ", ".join(f"{name} AS ({sql})" for name, sql in SQL.items())


def _views(spark, sf_dir) -> dict:
    for table in _SOURCES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    views = {name: spark.sql(sql) for name, sql in SQL.items() if name != "match_decisions"}
    # A file's size tells little of what its keys take in memory: by it, orders would be broadcast to all lines far too long.
    load(spark, sf_dir, "orders").hint("merge").createOrReplaceTempView("orders")
    views["match_decisions"] = spark.sql(SQL["match_decisions"])
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return {name: views[name] for name in SQL}


# ---- review queue ----------------------------------------------------------------------------------



def _branch(table: str, category: str, source: str, label: str, scored: bool) -> str:
    score = "confidence_score" if scored else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT organization_id, id AS reference_id, task_id, task_run_id, data_source_id, '{category}' AS review_category,"
        f" 'PENDING_REVIEW' AS review_type, '{source}' AS source, '{label}' AS label, {score} AS confidence_score,"
        f" CAST(NULL AS VARCHAR) AS reason, created_at FROM {table} WHERE status = 'pending_review'"
    )


def _download(table: str, key: str) -> str:
    return (
        "SELECT a.organization_id, a.id, p.task_id, p.task_run_id, p.data_source_id, 'DOWNLOAD',"
        " CASE outcome WHEN 'integrity_failed' THEN 'INTEGRITY_FAILURE' ELSE 'FAILED' END, 'artifact_download_event',"
        " CASE outcome WHEN 'integrity_failed' THEN 'Artifact Integrity Verification Failed' ELSE 'Artifact Delivery Failed' END,"
        f" NULL, failure_reason_code, a.created_at FROM artifact_download_events a JOIN {table} p ON p.id = a.{key}"
        " WHERE outcome IN ('integrity_failed', 'file_missing', 'stream_failed')"
    )


QUEUE = f"""WITH {CTES}, everything AS ({" UNION ALL ".join([
    _branch(t, c, s, l, t != "export_runs") for t, c, s, l in review_queue.PENDING
] + [
    "SELECT d.organization_id, d.id, r.task_id, r.task_run_id, r.data_source_id, 'MATCHING', 'AMBIGUOUS', 'match_decision',"
    " 'Ambiguous Match Decision', d.confidence_score, d.reason, d.created_at FROM match_decisions d JOIN match_runs r"
    " ON r.id = d.match_run_id WHERE decision = 'ambiguous'",
    "SELECT x.organization_id, x.id, x.task_id, x.id, t.data_source_id, 'SYSTEM', 'FAILED', 'task_run',"
    " 'Failed Processing Run', NULL, error_message, x.created_at FROM task_runs x JOIN tasks t ON t.id = x.task_id"
    " WHERE status = 'failed'",
] + [_download(t, k) for t, k in review_queue.DOWNLOAD_PARENTS])}),
    queue AS (SELECT * FROM everything WHERE organization_id = 'org1')"""
_SHOWN = ", ".join(review_queue.COLUMNS)


@query("review_queue_items", f"{QUEUE} SELECT {_SHOWN} FROM queue")
def review_queue_items(spark, sf_dir):
    return review_queue.queue(_views(spark, sf_dir), "org1")


@query("review_queue_page", f"{QUEUE} SELECT {_SHOWN} FROM queue ORDER BY created_at, reference_id LIMIT 50 OFFSET 100")
def review_queue_page(spark, sf_dir):
    return review_queue.page(review_queue.filtered(_views(spark, sf_dir), "org1"), limit=50, offset=100)


def _stored_queue(spark, sf_dir, sort):
    """The queue of a tenant, stored in the order of a column in the shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/queue-{uuid.uuid4()}"
    paging.store_ordered(review_queue.filtered(_views(spark, sf_dir), "org1"), path, sort, 50)
    return path


@query(
    "review_queue_deep_page",
    f"{QUEUE} SELECT {_SHOWN} FROM queue ORDER BY created_at, reference_id LIMIT 100 OFFSET 900",
)
def review_queue_deep_page(spark, sf_dir):
    """A page far from the start, by reading only the ranges of the stored queue that it lies in."""
    return paging.stored_page(spark, _stored_queue(spark, sf_dir, "created_at"), "created_at", 100, 900)


@query(
    "review_queue_deep_by_confidence",
    f"{QUEUE} SELECT {_SHOWN} FROM queue ORDER BY confidence_score ASC NULLS LAST, reference_id LIMIT 100 OFFSET 700",
)
def review_queue_deep_by_confidence(spark, sf_dir):
    """The same by confidence, where very many items share a value or have none."""
    return paging.stored_page(spark, _stored_queue(spark, sf_dir, "confidence_score"), "confidence_score", 100, 700)


@query("review_queue_stored_total", f"{QUEUE} SELECT count(*) AS total FROM queue")
def review_queue_stored_total(spark, sf_dir):
    return paging.total(spark, _stored_queue(spark, sf_dir, "created_at"))


@query(
    "review_queue_by_confidence",
    f"{QUEUE} SELECT {_SHOWN} FROM queue ORDER BY confidence_score ASC NULLS LAST, reference_id LIMIT 100 OFFSET 20",
)
def review_queue_by_confidence(spark, sf_dir):
    items = review_queue.filtered(_views(spark, sf_dir), "org1")
    return review_queue.page(items, "confidence_score", 100, 20)


_FILTER = "review_category IN ('PROCESSING', 'DOWNLOAD') AND review_type IN ('PENDING_REVIEW', 'INTEGRITY_FAILURE')"


@query("review_queue_filtered", f"{QUEUE} SELECT {_SHOWN} FROM queue WHERE {_FILTER} AND source <> 'standardization_run'")
def review_queue_filtered(spark, sf_dir):
    filters = review_queue.Filters(
        ("PROCESSING", "DOWNLOAD"), ("PENDING_REVIEW", "INTEGRITY_FAILURE"), ("cleaning_run", "artifact_download_event")
    )
    return review_queue.filtered(_views(spark, sf_dir), "org1", filters)


@query(
    "review_queue_search",
    f"{QUEUE} SELECT {', '.join('q.' + c for c in review_queue.COLUMNS)} FROM queue q LEFT JOIN tasks t ON t.id = q.task_id"
    " LEFT JOIN data_sources d ON d.id = q.data_source_id WHERE lower(t.name) LIKE '%mach%' OR lower(d.name) LIKE '%mach%'",
)
def review_queue_search(spark, sf_dir):
    return review_queue.filtered(_views(spark, sf_dir), "org1", review_queue.Filters(search="  MACH "))


@query(
    "review_queue_summary",
    f"{QUEUE} SELECT count(*) AS total_items, count(*) FILTER (WHERE review_type = 'PENDING_REVIEW') AS pending_reviews,"
    " count(*) FILTER (WHERE review_type = 'AMBIGUOUS') AS ambiguous_matches,"
    " count(*) FILTER (WHERE review_category = 'SYSTEM' AND review_type = 'FAILED') AS failed_runs,"
    " count(*) FILTER (WHERE review_category = 'DOWNLOAD') AS download_failures FROM queue",
)
def review_queue_summary(spark, sf_dir):
    return review_queue.summary(review_queue.filtered(_views(spark, sf_dir), "org1"))


# ---- retention -------------------------------------------------------------------------------------


def _eligible(table: str, kind: str, rank: int) -> str:
    at = "CASE status WHEN 'approved' THEN approved_at WHEN 'rejected' THEN rejected_at WHEN 'rolled_back' THEN rolled_back_at END"
    return (
        f"SELECT '{kind}' AS artifact_type, {rank} AS type_rank, id AS run_id, organization_id, output_file_path,"
        f" {at} AS decided_at FROM {table} WHERE status <> 'pending_review' AND output_deleted_at IS NULL"
        f" AND {at} <= CAST('{NOW}' AS TIMESTAMP) - INTERVAL 90 DAY"
    )


_KINDS = {"cleaning": "cleaning_runs", "standardization": "standardization_runs", "export": "export_runs"}
DUE = f"WITH {CTES}, due AS ({' UNION ALL '.join(_eligible(t, k, i) for i, (k, t) in enumerate(_KINDS.items()))})"
LISTING = (
    "listing AS (" + " UNION ALL ".join(
        f"SELECT output_file_path AS path, length(task_run_id) * 100 AS size_bytes FROM {t} WHERE data_source_id <> 'd3'"
        f" AND output_file_path LIKE '/out/%'"
        for t in _KINDS.values()
    ) + ")"
)


def _candidates(spark, sf_dir):
    tables = _views(spark, sf_dir)
    chosen = {kind: tables[t] for kind, t in _KINDS.items()}
    return retention.eligible(chosen, NOW, 90), chosen


def _listing(chosen):
    from functools import reduce

    parts = [
        runs.where("data_source_id <> 'd3' AND output_file_path LIKE '/out/%'").selectExpr(
            "output_file_path AS path", "length(task_run_id) * 100 AS size_bytes"
        )
        for runs in chosen.values()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "retention_eligible",
    f"{DUE} SELECT artifact_type, type_rank, run_id, organization_id, output_file_path, CAST(decided_at AS VARCHAR) AS decided_at FROM due",
)
def retention_eligible(spark, sf_dir):
    due, _ = _candidates(spark, sf_dir)
    return due.withColumn("decided_at", F.col("decided_at").cast("string"))


@query(
    "retention_batch",
    f"{DUE} SELECT artifact_type, run_id FROM due ORDER BY type_rank, decided_at, run_id LIMIT 50",
)
def retention_batch(spark, sf_dir):
    return retention.batch(_candidates(spark, sf_dir)[0], retention.BATCH_SIZE).select("artifact_type", "run_id")


_OUTCOME = (
    "CASE WHEN output_file_path NOT LIKE '/out/' || organization_id || '/%' THEN 'failed' WHEN size_bytes IS NULL"
    " THEN 'already_missing' ELSE 'completed' END"
)
_PLAN = (
    f"{DUE}, {LISTING}, plan AS (SELECT artifact_type, run_id, organization_id, {_OUTCOME} AS outcome,"
    f" CASE WHEN {_OUTCOME} = 'failed' THEN 'unsafe_path' END AS failure_reason_code, size_bytes AS artifact_size_bytes,"
    " true AS dry_run FROM due LEFT JOIN listing ON path = output_file_path)"
)


@query("retention_plan", f"{_PLAN} SELECT * FROM plan")
def retention_plan(spark, sf_dir):
    due, chosen = _candidates(spark, sf_dir)
    return retention.plan(due, _listing(chosen), "/out")


@query(
    "retention_tallies",
    f"{_PLAN} SELECT count(*) FILTER (WHERE outcome = 'completed') AS purged_count,"
    " count(*) FILTER (WHERE outcome = 'already_missing') AS already_missing_count,"
    " count(*) FILTER (WHERE outcome = 'failed') AS failed_count, 0 AS dry_run_would_purge_count,"
    " CAST(sum(artifact_size_bytes) FILTER (WHERE outcome = 'completed') AS BIGINT) AS bytes_reclaimed,"
    " count(*) AS candidates_considered FROM plan",
)
def retention_tallies(spark, sf_dir):
    due, chosen = _candidates(spark, sf_dir)
    return retention.tallies(retention.plan(due, _listing(chosen), "/out", dry_run=False))


@query(
    "retention_backlog",
    f"{DUE} SELECT count(*) AS backlog_count,"
    f" CAST(epoch(CAST('{NOW}' AS TIMESTAMP)) - epoch(min(decided_at)) AS DOUBLE) AS oldest_age_seconds FROM due",
)
def retention_backlog(spark, sf_dir):
    return retention.backlog(_candidates(spark, sf_dir)[0], NOW)


# ---- review actions --------------------------------------------------------------------------------

def _step(a: str) -> str:
    return (
        f"SELECT 'x' || CAST({O} AS STRING) || '{a}' AS action_id, 'c' || CAST({O} AS STRING) AS run_id,"
        f" CASE WHEN '{a}' = '3' THEN 'rollback' WHEN ({O} + {a}) % 3 = 0 THEN 'reject' ELSE 'approve' END AS action,"
        f" 'u' || CAST(o_custkey % 9 AS STRING) AS actor, CAST(o_orderdate AS STRING) || '{a}' AS acted_at"
        " FROM orders"
    )


_ACTIONS = " UNION ALL ".join(_step(a) for a in "123")
_FIRST = "CASE WHEN ({o} + 1) % 3 = 0 THEN 'rejected' ELSE 'approved' END"
_KEY = "CAST(substr(id, 2) AS BIGINT)"
_ONE = _FIRST.format(o=_KEY)


@query(
    "review_actions_status",
    f"WITH {CTES} SELECT id, CASE status WHEN 'pending_review' THEN CASE WHEN {_ONE} = 'approved' THEN 'rolled_back'"
    f" ELSE 'rejected' END WHEN 'approved' THEN 'rolled_back' ELSE status END AS status FROM cleaning_runs",
)
def review_actions_status(spark, sf_dir):
    tables = _views(spark, sf_dir)
    updated, _ = review_actions.apply_actions(tables["cleaning_runs"], spark.sql(_ACTIONS))
    return updated.select("id", "status")


@query(
    "review_actions_conflicts",
    f"""WITH {CTES}, acts AS ({_ACTIONS}), seen AS (SELECT a.*, right(action_id, 1) AS step, status, {_ONE} AS first
        FROM acts a JOIN cleaning_runs r ON r.id = a.run_id),
    judged AS (SELECT *, CASE WHEN status = 'pending_review' THEN CASE step WHEN '1' THEN NULL WHEN '2' THEN first
                         ELSE CASE first WHEN 'approved' THEN NULL ELSE first END END
                    WHEN status = 'approved' THEN CASE step WHEN '3' THEN NULL ELSE status END ELSE status END AS stood FROM seen)
    SELECT action_id, run_id, action, 'Cannot ' || action || ' a run with status ''' || stood || '''' AS detail
    FROM judged WHERE stood IS NOT NULL""",
)
def review_actions_conflicts(spark, sf_dir):
    tables = _views(spark, sf_dir)
    return review_actions.apply_actions(tables["cleaning_runs"], spark.sql(_ACTIONS))[1]


# ---- lineage ---------------------------------------------------------------------------------------

_STAGE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'transform' WHEN '2-HIGH' THEN 'standardize' WHEN '3-MEDIUM' THEN 'match'"
    " WHEN '5-LOW' THEN 'export' ELSE 'sync' END"
)
_CHAIN = (
    f"SELECT 'org' || CAST(o_custkey % 3 AS STRING) AS organization_id, CAST({O} AS STRING) AS task_run_id,"
    f" {_STAGE} AS task_type, CASE WHEN {O} % 9 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS source_task_run_id,"
    f" CASE WHEN {O} % 13 <> 0 THEN {_status(O)} END AS result_status FROM orders"
)


@query(
    "lineage_gate",
    f"""WITH runs AS ({_CHAIN}), j AS (SELECT r.*, u.task_type AS upstream_type, u.result_status AS upstream_status,
        CASE r.task_type WHEN 'transform' THEN 'sync' WHEN 'standardize' THEN 'transform' WHEN 'match' THEN 'standardize'
             WHEN 'export' THEN 'match' END AS wants
        FROM runs r LEFT JOIN runs u ON u.organization_id = r.organization_id AND u.task_run_id = r.source_task_run_id)
    SELECT organization_id, task_run_id, task_type, source_task_run_id, upstream_status,
        CASE WHEN wants IS NULL THEN CASE WHEN source_task_run_id IS NOT NULL THEN 'source_not_allowed' END
             WHEN source_task_run_id IS NULL THEN 'source_required' WHEN upstream_type IS NULL THEN 'source_not_found'
             WHEN upstream_type <> wants THEN 'source_wrong_type' WHEN upstream_status IS NULL THEN 'source_has_no_result'
             WHEN wants <> 'sync' AND upstream_status <> 'approved' THEN 'source_not_approved' END AS block_reason FROM j""",
)
def lineage_gate(spark, sf_dir):
    _views(spark, sf_dir)
    return lineage.gate_report(spark.sql(_CHAIN))


@query(
    "lineage_chain",
    f"""WITH runs AS ({_CHAIN}) SELECT r.organization_id, r.task_run_id, r.source_task_run_id AS up1,
        a.source_task_run_id AS up2, b.source_task_run_id AS up3 FROM runs r
        LEFT JOIN runs a ON a.organization_id = r.organization_id AND a.task_run_id = r.source_task_run_id
        LEFT JOIN runs b ON b.organization_id = r.organization_id AND b.task_run_id = a.source_task_run_id""",
)
def lineage_chain(spark, sf_dir):
    _views(spark, sf_dir)
    return lineage.chain(spark.sql(_CHAIN), 3)


@query(
    "lineage_approved_inputs",
    f"""WITH runs AS ({_CHAIN}) SELECT organization_id, source_task_run_id, task_run_id FROM runs r
        WHERE EXISTS (SELECT 1 FROM runs u WHERE u.organization_id = r.organization_id
                      AND u.task_run_id = r.source_task_run_id AND u.result_status = 'approved')""",
)
def lineage_approved_inputs(spark, sf_dir):
    _views(spark, sf_dir)
    chain = spark.sql(_CHAIN)
    results = chain.select("organization_id", "task_run_id", F.col("result_status").alias("status"))
    return lineage.approved_inputs(chain, results).select("organization_id", "source_task_run_id", "task_run_id")


_FORGED = f"{O} % 1009 IN (500, 501)"
_LONG = (
    f"SELECT 'org' || CAST(({O} // 97) % 3 AS STRING) AS organization_id, CAST({O} AS STRING) AS task_run_id,"
    f" CASE WHEN {_FORGED} THEN CAST({O} + CASE {O} % 1009 WHEN 500 THEN 1 ELSE -1 END AS STRING)"
    f" WHEN {O} % 97 = 0 THEN NULL ELSE CAST({O} - 1 - o_custkey % 2 AS STRING) END AS source_task_run_id FROM orders"
)


@query(
    "lineage_roots",
    f"""WITH RECURSIVE runs AS ({_LONG}),
        known AS (SELECT r.*, p.task_run_id AS parent FROM runs r LEFT JOIN runs p
            ON p.organization_id = r.organization_id AND p.task_run_id = r.source_task_run_id),
        down AS (SELECT organization_id, task_run_id, task_run_id AS root_run_id, 0 AS depth FROM known WHERE parent IS NULL
            UNION ALL SELECT k.organization_id, k.task_run_id, d.root_run_id, d.depth + 1 FROM known k
            JOIN down d ON d.organization_id = k.organization_id AND d.task_run_id = k.parent)
    SELECT organization_id, task_run_id, root_run_id, depth FROM runs LEFT JOIN down USING (organization_id, task_run_id)""",
)
def lineage_roots(spark, sf_dir):
    """Chains of up to 96 steps, with runs that name each other as their source."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return lineage.roots(spark.sql(_LONG.replace("//", "div")))


_SOURCED = _CHAIN.replace(" FROM orders", ", CASE WHEN o_custkey % 6 <> 0 THEN 's' || CAST(o_custkey % 9 AS STRING) END AS data_source_id FROM orders")
_USABLE = (
    "SELECT 's' || CAST(c_custkey % 8 AS STRING) AS id, 'org' || CAST(c_custkey % 3 AS STRING) AS organization_id,"
    " c_custkey % 8 <> 5 AS is_active FROM customer"
)


@query(
    "lineage_gate_sources",
    f"""WITH runs AS ({_SOURCED}), sources AS (SELECT DISTINCT * FROM ({_USABLE}) WHERE is_active),
        j AS (SELECT r.*, u.task_type AS upstream_type, u.result_status AS upstream_status, s.id AS usable,
            CASE r.task_type WHEN 'transform' THEN 'sync' WHEN 'standardize' THEN 'transform' WHEN 'match' THEN 'standardize'
             WHEN 'export' THEN 'match' END AS wants
        FROM runs r LEFT JOIN runs u ON u.organization_id = r.organization_id AND u.task_run_id = r.source_task_run_id
        LEFT JOIN sources s ON s.organization_id = r.organization_id AND s.id = r.data_source_id)
    SELECT organization_id, task_run_id, task_type, source_task_run_id, upstream_status,
        CASE WHEN data_source_id IS NOT NULL AND usable IS NULL THEN 'source_inactive'
             WHEN wants IS NULL THEN CASE WHEN source_task_run_id IS NOT NULL THEN 'source_not_allowed' END
             WHEN source_task_run_id IS NULL THEN 'source_required' WHEN upstream_type IS NULL THEN 'source_not_found'
             WHEN upstream_type <> wants THEN 'source_wrong_type' WHEN upstream_status IS NULL THEN 'source_has_no_result'
             WHEN wants <> 'sync' AND upstream_status <> 'approved' THEN 'source_not_approved' END AS block_reason FROM j""",
)
def lineage_gate_sources(spark, sf_dir):
    """The gate with the test of the data source: it has to be an active one of the run's organization."""
    _views(spark, sf_dir)
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return lineage.gate_report(spark.sql(_SOURCED), spark.sql(_USABLE))


# ---- versioned configuration -----------------------------------------------------------------------

_SETS = (
    "SELECT 'r' || CAST(p_partkey AS STRING) AS id, 'org' || CAST(p_partkey % 3 AS STRING) AS organization_id,"
    " CASE p_partkey % 4 WHEN 0 THEN NULL ELSE p_brand END AS data_source_id,"
    " CASE WHEN p_partkey % 10 = 0 THEN 0.3 ELSE 0.9 END AS duplicate_threshold, 0.4 AS review_threshold,"
    " lpad(CAST(p_partkey AS STRING), 9, '0') AS created_at FROM part"
)


def _rule_field(column: str) -> str:
    return (
        "SELECT 'r' || CAST(CASE WHEN p_size = 50 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS rule_set_id,"
        f" {column} AS column_name,"
        " CASE WHEN p_partkey % 11 = 0 THEN 'fuzzy' ELSE 'exact' END AS comparison_type,"
        f" CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE 1.0 END AS weight FROM part"
    )


_FIELDS = (
    _rule_field("'name'") + " UNION ALL "
    + _rule_field("CASE WHEN p_partkey % 7 = 0 THEN ' NAME' ELSE 'email' END")
)
_PROBLEMS = f"""WITH sets AS ({_SETS}), fields AS ({_FIELDS}),
    bad AS (SELECT s.id, CASE WHEN review_threshold >= duplicate_threshold THEN 'review_not_below_duplicate'
        WHEN n IS NULL THEN 'no_fields' WHEN unknown > 0 THEN 'unknown_comparison' WHEN weightless > 0 THEN 'weight_not_positive'
        WHEN names < n THEN 'column_twice' END AS problem
      FROM sets s LEFT JOIN (SELECT rule_set_id, count(*) AS n, count(DISTINCT lower(trim(column_name))) AS names,
        count(*) FILTER (WHERE weight <= 0) AS weightless, count(*) FILTER (WHERE comparison_type = 'fuzzy') AS unknown
        FROM fields GROUP BY 1) f ON f.rule_set_id = s.id)"""


def _rule_sets(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_SETS), spark.sql(_FIELDS)


@query("rule_set_problems", f"{_PROBLEMS} SELECT id, problem FROM bad WHERE problem IS NOT NULL")
def rule_set_problems(spark, sf_dir):
    return config_tables.rule_set_problems(*_rule_sets(spark, sf_dir))


_PUBLISHED = f"""{_PROBLEMS}, good AS (SELECT s.* FROM sets s JOIN bad USING (id) WHERE problem IS NULL),
    published AS (SELECT id, organization_id, data_source_id,
        row_number() OVER (PARTITION BY organization_id, data_source_id ORDER BY created_at) AS version,
        row_number() OVER (PARTITION BY organization_id, data_source_id ORDER BY created_at DESC) = 1 AS is_active FROM good)"""


def _published(spark, sf_dir):
    sets, fields = _rule_sets(spark, sf_dir)
    none = sets.where(F.lit(False)).withColumns({"version": F.lit(1), "is_active": F.lit(True)})
    return config_tables.publish_rule_sets(none, sets, fields)


@query("rule_set_versions", f"{_PUBLISHED} SELECT id, organization_id, data_source_id, version, is_active FROM published")
def rule_set_versions(spark, sf_dir):
    return _published(spark, sf_dir).select("id", "organization_id", "data_source_id", "version", "is_active")


_WANTED = "SELECT DISTINCT 'org' || CAST(p_partkey % 4 AS STRING) AS organization_id, p_brand AS data_source_id FROM part"


@query(
    "rule_set_resolved",
    f"""{_PUBLISHED}, wanted AS ({_WANTED}), a AS (SELECT * FROM published WHERE is_active)
    SELECT w.organization_id, w.data_source_id, coalesce(o.id, t.id) AS rule_set_id FROM wanted w
    LEFT JOIN a o ON o.organization_id = w.organization_id AND o.data_source_id = w.data_source_id
    LEFT JOIN a t ON t.organization_id = w.organization_id AND t.data_source_id IS NULL""",
)
def rule_set_resolved(spark, sf_dir):
    """The rule set of each data source: its own, else its tenant's."""
    published = _published(spark, sf_dir)
    return config_tables.resolved_rule_sets(published, spark.sql(_WANTED))


@query("rule_set_latest", f"{_PUBLISHED} SELECT id, version FROM published WHERE is_active")
def rule_set_latest(spark, sf_dir):
    return config_tables.latest_rule_sets(_published(spark, sf_dir)).select("id", "version")


_ENTRY = (
    "SELECT '{p}' || CAST(c_custkey AS STRING) AS id, 'org' || CAST(c_nationkey % 2 AS STRING) AS organization_id,"
    " CASE c_nationkey % 3 WHEN 0 THEN NULL ELSE c_mktsegment END AS field_type,"
    " CASE c_custkey % 2 WHEN 0 THEN ' Key' ELSE 'KEY' END || CAST(c_custkey % {n} AS STRING) AS lookup_key,"
    " c_custkey % 4 <> 0 AS is_active, lpad(CAST(c_custkey AS STRING), 9, '0') AS created_at FROM customer"
)
_OLD, _NEW = _ENTRY.format(p="o", n=200), _ENTRY.format(p="n", n=350)


@query(
    "lookup_publish_accepted",
    f"""WITH old AS ({_OLD}), fresh AS ({_NEW}), ranked AS (SELECT *, row_number() OVER (PARTITION BY organization_id, field_type,
        lower(trim(lookup_key)) ORDER BY created_at, id) AS r FROM fresh)
    SELECT id FROM ranked f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.is_active AND o.organization_id = f.organization_id
        AND o.field_type IS NOT DISTINCT FROM f.field_type AND lower(trim(o.lookup_key)) = lower(trim(f.lookup_key)))""",
)
def lookup_publish_accepted(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    accepted, _ = config_tables.publish_entries(spark.sql(_OLD), spark.sql(_NEW), "field_type", "lookup_key")
    return accepted.select("id")


@query("taken_names", f"WITH {CTES} SELECT organization_id, lower(trim(name)) AS name_key, count(*) AS n FROM tasks WHERE is_active GROUP BY ALL HAVING count(*) > 1")
def taken_names(spark, sf_dir):
    return config_tables.taken_names(_views(spark, sf_dir)["tasks"])


# ---- schedules, runs, metrics ----------------------------------------------------------------------


@query(
    "due_schedules",
    f"WITH {CTES} SELECT id, CAST(next_run_at AS VARCHAR) AS next_run_at, CAST(CAST('{NOW}' AS TIMESTAMP) +"
    " schedule_interval_seconds * INTERVAL 1 SECOND AS VARCHAR) AS following_run_at FROM tasks"
    f" WHERE schedule_interval_seconds IS NOT NULL AND is_active AND next_run_at <= CAST('{NOW}' AS TIMESTAMP)"
    " ORDER BY tasks.next_run_at, id LIMIT 50",
)
def due_schedules(spark, sf_dir):
    due = runs.due_schedules(_views(spark, sf_dir)["tasks"], NOW, runs.SCHEDULE_BATCH)
    return due.select(
        "id", F.col("next_run_at").cast("string").alias("next_run_at"),
        F.col("following_run_at").cast("string").alias("following_run_at"),
    )


_RUNTIME = "2024-01-03 12:00:00"


@query(
    "claimable_runs",
    f"WITH {CTES} SELECT x.id, timeout_seconds FROM task_runs x JOIN tasks t ON t.id = x.task_id WHERE status = 'pending'"
    f" AND (next_retry_at IS NULL OR next_retry_at <= CAST('{_RUNTIME}' AS TIMESTAMP)) ORDER BY x.created_at, x.id LIMIT 5",
)
def claimable_runs(spark, sf_dir):
    tables = _views(spark, sf_dir)
    return runs.claimable_runs(tables["task_runs"], tables["tasks"], _RUNTIME, runs.CLAIM_BATCH).select("id", "timeout_seconds")


@query(
    "stuck_runs",
    f"WITH {CTES} SELECT id FROM task_runs WHERE status = 'running' AND lease_expires_at < CAST('{_RUNTIME}' AS TIMESTAMP)",
)
def stuck_runs(spark, sf_dir):
    return runs.stuck_runs(_views(spark, sf_dir)["task_runs"], _RUNTIME).select("id")


@query(
    "retry_delay",
    f"""WITH {CTES}, judged AS (SELECT *, retryable AND attempt_count < coalesce(max_attempts, 3) AS again FROM task_runs
        WHERE status = 'failed') SELECT id, again AS will_retry, CASE WHEN again THEN
        CAST(least(30 * pow(2, attempt_count - 1), 900) AS BIGINT) END AS delay_seconds FROM judged""",
)
def retry_delay(spark, sf_dir):
    failed = _views(spark, sf_dir)["task_runs"].where("status = 'failed'")
    return runs.retry_plan(failed).select("id", "will_retry", "delay_seconds")


_EVENTS = (
    "SELECT CASE event_type WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed'"
    " WHEN 'signup' THEN 'requeued' ELSE 'created' END AS event_type FROM events"
)


@query(
    "run_metrics",
    f"WITH e AS ({_EVENTS}) SELECT CASE event_type WHEN 'succeeded' THEN 'completed' WHEN 'requeued' THEN 'retried' ELSE"
    " event_type END AS counter, count(*) AS value FROM e WHERE event_type <> 'created' GROUP BY 1",
)
def run_metrics(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return runs.event_counters(spark.sql(_EVENTS))


_BOUNDS = ["0.1", "0.5", "1.0", "5.0", "15.0", "30.0", "60.0", "120.0", "300.0", "600.0", "1800.0"]


@query(
    "duration_histogram",
    " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (WHERE value <= {b}) AS value FROM events" for b in _BOUNDS)
    + " UNION ALL SELECT '+Inf', count(value) FROM events",
)
def duration_histogram(spark, sf_dir):
    return runs.duration_histogram(_views(spark, sf_dir)["task_runs"])


@query("queue_depth", "SELECT count(*) AS queue_depth FROM events WHERE event_type = 'view'")
def queue_depth(spark, sf_dir):
    return runs.queue_depth(_views(spark, sf_dir)["task_runs"])


# ---- audit browsing --------------------------------------------------------------------------------


@query(
    "audit_decisions_page",
    f"WITH {CTES} SELECT id, record_a_row_index, record_b_row_index, decision FROM match_decisions WHERE decision = 'ambiguous'"
    " ORDER BY record_a_row_index, record_b_row_index, id LIMIT 50 OFFSET 50",
)
def audit_decisions_page(spark, sf_dir):
    log = audit.select_rows(_views(spark, sf_dir)["match_decisions"], decision="ambiguous", match_run_id=None)
    return audit.page(log, "decisions", 50, 50).select("id", "record_a_row_index", "record_b_row_index", "decision")


@query(
    "audit_runs_page",
    f"WITH {CTES} SELECT id, created_at FROM task_runs WHERE organization_id = 'org2' ORDER BY created_at DESC, id LIMIT 100",
)
def audit_runs_page(spark, sf_dir):
    log = audit.select_rows(_views(spark, sf_dir)["task_runs"], organization_id="org2")
    return audit.page(log, "task_runs", 100).select("id", "created_at")


_EXCLUSIONS = (
    f"SELECT CAST({L} AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, 'x' || CAST({L} % 5 AS STRING) AS export_run_id,"
    f" 'g' || CAST({L} % 40 AS STRING) AS match_group_id, {L} AS row_index FROM lineitem"
)


@query(
    "audit_exclusions",
    f"SELECT id, row_index FROM ({_EXCLUSIONS}) WHERE export_run_id = 'x2' AND match_group_id = 'g7'",
)
def audit_exclusions(spark, sf_dir):
    """The exclusion log of one run, by the group that a row was excluded for."""
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    log = spark.sql(_EXCLUSIONS)
    return audit.select_rows(log, export_run_id="x2", match_group_id="g7", row_index=None).select("id", "row_index")


@query("audit_total", f"WITH {CTES} SELECT count(*) AS total FROM match_decisions WHERE decision = 'ambiguous'")
def audit_total(spark, sf_dir):
    return audit.total(audit.select_rows(_views(spark, sf_dir)["match_decisions"], decision="ambiguous"))


# ---- expectations ----------------------------------------------------------------------------------


def _broken(table: str, name: str, rule: str) -> str:
    return f"SELECT '{table}' AS table_name, '{name}' AS expectation, id AS key FROM {table} WHERE NOT ({rule})"


_CHECKED = ("cleaning_runs", "export_runs", "match_decisions", "artifact_download_events", "task_runs", "tasks")


@query(
    "expectations",
    f"WITH {CTES} " + " UNION ALL ".join(_broken(t, n, r) for t in _CHECKED for n, r in expect.CHECKS[t].items()),
)
def expectations(spark, sf_dir):
    tables = _views(spark, sf_dir)
    return expect.check_all({t: tables[t] for t in _CHECKED})


@query(
    "expectations_unique",
    "SELECT 'cleaning_runs' AS table_name, 'unique_task_run_id' AS expectation, CAST(l_orderkey AS VARCHAR) AS key"
    " FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def expectations_unique(spark, sf_dir):
    results = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_run_id"))
    return expect.duplicates("cleaning_runs", results)


# ---- secrets in metadata ---------------------------------------------------------------------------

_META = (
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{\"host\": \"h\", \"Api_Key\": ' || CAST(user_id AS STRING)"
    " || '}' WHEN 2 THEN '{\"opts\": [{\"a\": 1}, {\"dbPassword\": \"x\"}]}' WHEN 3 THEN '{\"note\": \"token inside text\"}'"
    " ELSE 'not json' END AS meta FROM events"
)


@query(
    "secret_key_scan",
    f"WITH m AS ({_META}) SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'Api_Key' WHEN 2 THEN 'opts[1].dbPassword' END"
    " AS secret_path FROM m",
)
def secret_key_scan(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return secret_keys(spark.sql(_META), "meta").select("event_id", "secret_path")


