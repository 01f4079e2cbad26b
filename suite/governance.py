"""Further queries over logs, rules and configuration: what the other modules' queries do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import fixture, fixture_sql, load, query
from suite.matching import ALL, CAP, COMPOSITE, LINKED, WHOLE, _people, people_sql
from suite.operations import _FIELDS, _NEW, _OLD, _RUNTIME, _SETS, CTES, NOW, E, O, _broken, _views
from tidyledger.config import MatchLimits
from tidyledger.functions import text
from tidyledger.operators import expect
from tidyledger.operators.match import match
from tidyledger.plans import audit, config_tables, runs
from tidyledger.sources import sinks
from tidyledger.sources.tables import from_frame

# ---- logs ------------------------------------------------------------------------------------------


@query(
    "audit_decisions_of_a_run",
    f"WITH {CTES} SELECT id, decision FROM match_decisions WHERE organization_id = 'org1' AND decision = 'duplicate'",
)
def audit_decisions_of_a_run(spark, sf_dir):
    log = _views(spark, sf_dir)["match_decisions"]
    return audit.select_rows(log, organization_id="org1", decision="duplicate", match_run_id=None).select("id", "decision")


@query("due_schedules_all", f"""WITH {CTES} SELECT id FROM tasks WHERE schedule_interval_seconds IS NOT NULL AND is_active
    AND next_run_at <= CAST('{NOW}' AS TIMESTAMP) AND id NOT IN (SELECT id FROM tasks WHERE timeout_seconds IS NOT NULL)""")
def due_schedules_all(spark, sf_dir):
    tasks = _views(spark, sf_dir)["tasks"]
    return runs.due_schedules(tasks, NOW, skip=tasks.where("timeout_seconds IS NOT NULL")).select("id")


@query("claimable_runs_all", f"""WITH {CTES} SELECT x.id FROM task_runs x JOIN tasks t ON t.id = x.task_id
    WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= CAST('{_RUNTIME}' AS TIMESTAMP))""")
def claimable_runs_all(spark, sf_dir):
    tables = _views(spark, sf_dir)
    return runs.claimable_runs(tables["task_runs"], tables["tasks"], _RUNTIME).select("id")


@query("tasks_with_inactive", f"""WITH {CTES} SELECT 'active' AS listing, id FROM tasks WHERE is_active
    UNION ALL SELECT 'all', id FROM tasks""")
def tasks_with_inactive(spark, sf_dir):
    tasks = _views(spark, sf_dir)["tasks"]
    parts = {"active": config_tables.active(tasks), "all": config_tables.active(tasks, include_inactive=True)}
    named = [rows.select(F.lit(name).alias("listing"), "id") for name, rows in parts.items()]
    return named[0].unionByName(named[1])


# ---- configuration ---------------------------------------------------------------------------------


@query(
    "lookup_publish_refused",
    f"""WITH old AS ({_OLD}), fresh AS ({_NEW}), ranked AS (SELECT *, row_number() OVER (PARTITION BY organization_id, field_type,
        lower(trim(lookup_key)) ORDER BY created_at, id) AS r FROM fresh)
    SELECT id FROM ranked f WHERE r > 1 OR EXISTS (SELECT 1 FROM old o WHERE o.is_active AND o.organization_id = f.organization_id
        AND o.field_type IS NOT DISTINCT FROM f.field_type AND lower(trim(o.lookup_key)) = lower(trim(f.lookup_key)))""",
)
def lookup_publish_refused(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return config_tables.publish_entries(spark.sql(_OLD), spark.sql(_NEW), "field_type", "lookup_key")[1].select("id")


@query(
    "lookup_deactivate",
    f"WITH old AS ({_OLD}) SELECT id, is_active AND right(id, 1) <> '7' AS is_active FROM old",
)
def lookup_deactivate(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    old = spark.sql(_OLD)
    return config_tables.deactivate(old, old.where("right(id, 1) = '7'")).select("id", "is_active")


@query(
    "normalized_names_and_emails",
    f"WITH c AS ({fixture_sql('contacts')}) SELECT row_index, trim(full_name) AS name_key, lower(trim(email)) AS email_key FROM c",
)
def normalized_names_and_emails(spark, sf_dir):
    rows = fixture(spark, sf_dir, "contacts")
    return rows.select(
        "row_index", text.normalize_name(F.col("full_name")).alias("name_key"),
        text.normalize_email(F.col("email")).alias("email_key"),
    )


@query(
    "slugs_valid",
    "SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9]([a-z0-9-]*[a-z0-9])?') AND NOT contains(p_name, '--') AS valid"
    " FROM part",
)
def slugs_valid(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.is_valid_slug(F.col("p_name")).alias("valid"))


_ROW_HASH = (
    "sha256(CAST(o_orderkey AS VARCHAR) || chr(1) || CAST(o_custkey AS VARCHAR) || chr(1) || o_orderstatus || chr(1)"
    " || o_orderpriority)"
)


def _hash_sum(at: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)) AS VARCHAR)"


@query(
    "content_hash",
    f"SELECT count(*) AS row_count, {_hash_sum(1)} AS content_hash, {_hash_sum(16)} AS check_hash FROM"
    f" (SELECT {_ROW_HASH} AS h FROM orders)",
)
def content_hash(spark, sf_dir):
    """The digest itself, over rows dealt anew."""
    table = from_frame(load(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return sinks.content_hash(table.with_frame(table.frame.repartition(7)))


@query("content_hash_needs_no_order", "SELECT count(*) AS row_count, true AS same, true AS differs FROM customer")
def content_hash_needs_no_order(spark, sf_dir):
    table = from_frame(load(spark, sf_dir, "customer"), "c_custkey")
    dealt = table.with_frame(table.frame.repartition(7, "c1"))
    other = table.with_frame(table.frame.withColumn("c1", F.concat("c1", F.lit("x"))))
    hashes = [
        sinks.content_hash(t).select("row_count", F.struct("content_hash", "check_hash").alias(f"h{i}"))
        for i, t in enumerate((table, dealt, other))
    ]
    joined = hashes[0].join(hashes[1], "row_count").join(hashes[2], "row_count")
    return joined.select("row_count", (F.col("h0") == F.col("h1")).alias("same"), (F.col("h0") != F.col("h2")).alias("differs"))


# ---- what the decision log says --------------------------------------------------------------------

_PAIRS = (
    f"{people_sql(CAP, False)}, seen AS (SELECT j.*, x.fname AS name_a, y.fname AS name_b, x.fzone AS zone_a, y.fzone AS zone_b"
    " FROM judged j JOIN cand x ON x.rep = a JOIN cand y ON y.rep = b WHERE decision IS NOT NULL)"
)


@query(
    "match_field_comparisons",
    _PAIRS + "".join(
        f" {'UNION ALL' if i else ''} SELECT a, b, '{c}' AS field, {va} AS value_a, {vb} AS value_b, {va} = {vb} AS matched,"
        f" CAST({w} AS DOUBLE) AS weight, CASE WHEN {va} = {vb} THEN CAST({w} AS DOUBLE) ELSE 0.0 END AS contribution FROM seen"
        for i, (c, va, vb, w) in enumerate(
            (("email", "bk", "bk", 1.0), ("name", "name_a", "name_b", 0.3), ("zone", "zone_a", "zone_b", 0.3))
        )
    ),
)
def match_field_comparisons(spark, sf_dir):
    log = match(_people(spark, sf_dir), COMPOSITE, MatchLimits(CAP), ALL).field_decisions
    told = log.select("a", "b", F.explode("field_comparisons").alias("field", "c"))
    return told.select("a", "b", "field", "c.value_a", "c.value_b", "c.matched", "c.weight", "c.contribution")


@query(
    "match_decision_texts",
    f"""{_PAIRS}, told AS (SELECT *, 1 + CASE WHEN name_a = name_b THEN 1 ELSE 0 END + CASE WHEN zone_a = zone_b THEN 1 ELSE 0 END AS n
        FROM seen) SELECT a, b, printf('%d of 3 configured fields matched (score %.4f ', n, score) || CASE decision WHEN 'duplicate'
        THEN '>= threshold 0.7000)' ELSE 'is between the review threshold 0.4000 and the duplicate threshold 0.7000) -- '
        || 'flagged for manual review, not grouped' END AS reason FROM told""",
)
def match_decision_texts(spark, sf_dir):
    return match(_people(spark, sf_dir), COMPOSITE, MatchLimits(CAP), ALL).field_decisions.select("a", "b", "reason")


# The same without a block limit: the log has each row's links to the first rows it agrees with, in blocks of any size.


@query(
    "match_field_comparisons_all",
    LINKED + "".join(
        f" {'UNION ALL' if i else ''} SELECT a, b, '{c}' AS field, {va} AS value_a, {vb} AS value_b, {va} = {vb} AS matched,"
        f" CAST({w} AS DOUBLE) AS weight, CASE WHEN {va} = {vb} THEN CAST({w} AS DOUBLE) ELSE 0.0 END AS contribution FROM seen"
        for i, (c, va, vb, w) in enumerate(
            (("email", "bk", "bk", 1.0), ("name", "name_a", "name_b", 0.3), ("zone", "zone_a", "zone_b", 0.3))
        )
    ),
)
def match_field_comparisons_all(spark, sf_dir):
    log = match(_people(spark, sf_dir), COMPOSITE, WHOLE, ALL).field_decisions
    told = log.select("a", "b", F.explode("field_comparisons").alias("field", "c"))
    return told.select("a", "b", "field", "c.value_a", "c.value_b", "c.matched", "c.weight", "c.contribution")


@query(
    "match_decision_texts_all",
    f"""{LINKED}, told AS (SELECT *, 1 + CASE WHEN name_a = name_b THEN 1 ELSE 0 END + CASE WHEN zone_a = zone_b THEN 1 ELSE 0 END AS n
        FROM seen) SELECT a, b, printf('%d of 3 configured fields matched (score %.4f ', n, score) || CASE decision WHEN 'duplicate'
        THEN '>= threshold 0.7000)' ELSE 'is between the review threshold 0.4000 and the duplicate threshold 0.7000) -- '
        || 'flagged for manual review, not grouped' END AS reason FROM told""",
)
def match_decision_texts_all(spark, sf_dir):
    return match(_people(spark, sf_dir), COMPOSITE, WHOLE, ALL).field_decisions.select("a", "b", "reason")


# ---- expectations ----------------------------------------------------------------------------------

MORE = {
    "match_groups": "SELECT CAST(c_custkey AS STRING) AS id, c_custkey % 7 AS record_count FROM customer",
    "match_skipped_blocks": "SELECT CAST(s_suppkey AS STRING) AS id, s_suppkey % 9 AS block_size FROM supplier",
    "match_rule_fields": "SELECT rule_set_id || column_name AS id, rule_set_id, column_name, weight FROM rule_fields",
    "match_rule_sets": "SELECT id, organization_id, data_source_id, duplicate_threshold, review_threshold, 1 AS version,"
    " true AS is_active FROM rule_sets",
    "standardization_changes": "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,"
    " l_partkey - 5 AS row_index FROM lineitem",
    "artifact_retention_events": f"SELECT CAST({O} AS STRING) AS id,"
    f" CASE WHEN {O} % 4 = 0 THEN 'c' END AS cleaning_run_id, CASE WHEN {O} % 4 = 1 THEN 's' END AS standardization_run_id,"
    f" CASE WHEN {O} % 5 < 3 THEN 'e' END AS export_run_id,"
    " CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'lost' END AS outcome,"
    f" CASE WHEN {O} % 3 = 0 THEN 'unsafe_path' END AS failure_reason_code,"
    f" CASE WHEN {O} % 7 > 0 THEN o_orderdate END AS completed_at, {O} % 11 - 1 AS artifact_size_bytes FROM orders",
}
_RULES = f"rule_sets AS ({_SETS}), rule_fields AS ({_FIELDS}), " + ", ".join(f"{t} AS ({q})" for t, q in MORE.items())


def _more(spark, sf_dir) -> dict:
    for table in ("customer", "supplier", "lineitem", "orders", "part"):
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    spark.sql(_SETS).createOrReplaceTempView("rule_sets")
    spark.sql(_FIELDS).createOrReplaceTempView("rule_fields")
    return {t: spark.sql(q) for t, q in MORE.items()}


@query(
    "expectations_more",
    f"WITH {_RULES} " + " UNION ALL ".join(_broken(t, n, r) for t in MORE for n, r in expect.CHECKS[t].items()),
)
def expectations_more(spark, sf_dir):
    parts = [expect.violations(t, rows) for t, rows in _more(spark, sf_dir).items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query(
    "expectations_of_runs",
    f"WITH {CTES} " + " UNION ALL ".join(
        _broken(t, n, r) for t in ("standardization_runs", "match_runs") for n, r in expect.CHECKS[t].items()
    ),
)
def expectations_of_runs(spark, sf_dir):
    tables = _views(spark, sf_dir)
    parts = [expect.violations(t, tables[t]) for t in ("standardization_runs", "match_runs")]
    return parts[0].unionByName(parts[1])


@query(
    "expectations_unique_rules",
    f"""WITH {_RULES} SELECT 'match_rule_fields' AS table_name, 'unique_rule_set_id_column_name' AS expectation,
        rule_set_id || '/' || column_name AS key FROM match_rule_fields GROUP BY rule_set_id, column_name HAVING count(*) > 1
    UNION ALL SELECT 'match_rule_sets', 'unique_organization_id_data_source_id', organization_id || '/' ||
        coalesce(data_source_id, '-') FROM match_rule_sets WHERE is_active GROUP BY organization_id, data_source_id HAVING count(*) > 1""",
)
def expectations_unique_rules(spark, sf_dir):
    tables = _more(spark, sf_dir)
    return expect.duplicates("match_rule_fields", tables["match_rule_fields"]).unionByName(
        expect.duplicates("match_rule_sets", tables["match_rule_sets"])
    )
