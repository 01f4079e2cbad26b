"""Cleaning of messy customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import cells, fixture_sql, query, squeeze_sql
from tidyledger.config import AuditLimits
from tidyledger.operators import clean
from tidyledger.operators.stage import duplicate_count, missing_count

COLUMNS = ["name", "balance", "nation", "active", "joined", "segment"]
TYPES = ["string", "decimal", "integer", "boolean", "date", "string"]
_DECIMAL = "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)"


def blank_sql(value: str) -> str:
    return f"CASE WHEN lower({value}) IN ('null', 'n/a', 'na', '-', 'none') THEN '' ELSE {value} END"


def coerce_sql(value: str, kind: str) -> str:
    number = f"CAST({value} AS DECIMAL(30, 8))"
    plain = f"rtrim(rtrim(CAST({number} AS VARCHAR), '0'), '.')"
    if kind == "decimal":
        return f"CASE WHEN regexp_full_match({value}, '{_DECIMAL}') THEN {plain} ELSE {value} END"
    if kind == "integer":
        return (
            f"CASE WHEN regexp_full_match({value}, '[+-]?[0-9]+') THEN {value}"
            f" WHEN regexp_full_match({value}, '{_DECIMAL}') AND {number} = floor({number})"
            f" THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) ELSE {value} END"
        )
    if kind == "boolean":
        return (
            f"CASE WHEN lower({value}) IN ('true', 'yes', 'y', '1') THEN 'true'"
            f" WHEN lower({value}) IN ('false', 'no', 'n', '0') THEN 'false' ELSE {value} END"
        )
    if kind == "date":
        return f"CASE WHEN {value} = '' THEN '' ELSE strftime(CAST({value} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') END"
    return value


def steps_sql(fixture: str, columns: list[str], types: list[str]) -> str:
    """CTEs raw -> t -> b -> v over one fixture."""
    t = ", ".join(f"{squeeze_sql(c)} AS {c}_t" for c in columns)
    b = ", ".join(f"{blank_sql(c + '_t')} AS {c}_b" for c in columns)
    v = ", ".join(f"{coerce_sql(c + '_b', k)} AS {c}_v" for c, k in zip(columns, types))
    return (
        f"WITH raw AS ({fixture_sql(fixture)}), t AS (SELECT *, {t} FROM raw), b AS (SELECT *, {b} FROM t),"
        f" v AS (SELECT *, {v} FROM b)"
    )


_RULE_OF = {
    "decimal": "coerce_decimal", "integer": "coerce_integer", "boolean": "coerce_boolean",
    "date": "normalize_date_format",
}
_CONFIDENCE = (
    "CASE rule_name WHEN 'trim_whitespace' THEN 1.0 WHEN 'normalize_blank' THEN 0.9 WHEN 'coerce_integer' THEN 0.85"
    " WHEN 'coerce_decimal' THEN 0.8 WHEN 'coerce_boolean' THEN 0.9 ELSE 0.7 END"
)


def changes_sql(columns: list[str], types: list[str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(zip(columns, types)):
        levels = [(c, f"{c}_t", "trim_whitespace"), (f"{c}_t", f"{c}_b", "normalize_blank")]
        if kind in _RULE_OF:
            levels.append((f"{c}_b", f"{c}_v", _RULE_OF[kind]))
        for step, (before, after, rule) in enumerate(levels):
            parts.append(
                f"SELECT row_index, {i * 3 + step} AS ord, '{c}' AS column_name, {before} AS original_value,"
                f" {after} AS cleaned_value, '{rule}' AS rule_name FROM v WHERE {before} <> {after}"
            )
    return f", changes AS ({' UNION ALL '.join(parts)})"


STEPS = steps_sql("messy_customer", COLUMNS, TYPES)
CHANGES = STEPS + changes_sql(COLUMNS, TYPES)
_SINGLE = {
    "clean_trim": ("name", "string"), "clean_blank": ("segment", "string"), "clean_decimal": ("balance", "decimal"),
    "clean_integer": ("nation", "integer"), "clean_boolean": ("active", "boolean"), "clean_date": ("joined", "date"),
}

for _query, (_column, _kind) in _SINGLE.items():
    _sql = steps_sql("messy_customer", [_column], [_kind])

    @query(_query, f"{_sql} SELECT row_index, {_column} AS before, {_column}_v AS after FROM v")
    def _single(spark, sf_dir, column=_column, kind=_kind):
        trace = clean.trace_clean(cells(spark, sf_dir, "messy_customer", [column]), [kind])
        return trace.frame.select("row_index", F.col("c0").alias("before"), F.col(trace.latest[0]).alias("after"))


def _result(spark, sf_dir, limits=AuditLimits()):
    return clean.clean(cells(spark, sf_dir, "messy_customer", COLUMNS), TYPES, limits)


@query("clean_rows", f"{STEPS} SELECT row_index, {', '.join(f'{c}_v AS {c}' for c in COLUMNS)} FROM v")
def clean_rows(spark, sf_dir):
    return _result(spark, sf_dir).table.named()


@query(
    "clean_profiled_rows",
    f"{STEPS} SELECT row_index, {', '.join(f'{c}_v AS {c}' for c in COLUMNS)} FROM v",
)
def clean_profiled_rows(spark, sf_dir):
    return clean.clean_profiled(cells(spark, sf_dir, "messy_customer", COLUMNS)).table.named()


@query("clean_changes_by_rule", f"{CHANGES} SELECT rule_name, count(*) AS change_count FROM changes GROUP BY rule_name")
def clean_changes_by_rule(spark, sf_dir):
    return _result(spark, sf_dir).changes_by_rule


_LOG = f"row_index, column_name, original_value, cleaned_value, rule_name, {_CONFIDENCE} AS confidence"


@query("clean_change_log", f"{CHANGES} SELECT {_LOG} FROM changes")
def clean_change_log(spark, sf_dir):
    return _result(spark, sf_dir, AuditLimits(max_changes=None)).changes.drop("step_order", "reason")


@query("clean_change_log_cap", f"{CHANGES} SELECT {_LOG} FROM changes ORDER BY row_index, ord LIMIT 500")
def clean_change_log_cap(spark, sf_dir):
    return _result(spark, sf_dir, AuditLimits(max_changes=500)).changes.drop("step_order", "reason")


@query(
    "clean_confidence",
    f"{CHANGES} SELECT count(*) AS total_changes_count, coalesce(min({_CONFIDENCE}), 1.0) AS confidence_score FROM changes",
)
def clean_confidence(spark, sf_dir):
    return _result(spark, sf_dir).trace.summary().select("total_changes_count", "confidence_score")


O_COLUMNS = ["customer", "status", "priority"]
O_TYPES = ["integer", "string", "integer"]
O_STEPS = steps_sql("messy_orders", O_COLUMNS, O_TYPES)
_CLEANED = ", ".join(f"{c}_v" for c in O_COLUMNS)


@query(
    "clean_duplicates",
    f"{O_STEPS} SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_CLEANED} FROM v))"
    " AS duplicate_row_count FROM v",
)
def clean_duplicates(spark, sf_dir):
    return duplicate_count(clean.clean(cells(spark, sf_dir, "messy_orders"), O_TYPES).table)


@query("clean_missing", f"{O_STEPS} SELECT count(*) FILTER (WHERE priority_v = '') AS missing_value_total FROM v")
def clean_missing(spark, sf_dir):
    return missing_count(clean.clean(cells(spark, sf_dir, "messy_orders"), O_TYPES).table)


_TRIMMED = ", ".join(f"trim({c})" for c in O_COLUMNS)


@query(
    "clean_before_after",
    f"{O_STEPS} SELECT 'before' AS stage, count(*) AS row_count, count(*) FILTER (WHERE trim(priority) = '') AS"
    f" missing_value_total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_TRIMMED} FROM v)) AS duplicate_row_count"
    f" FROM v UNION ALL SELECT 'after', count(*), count(*) FILTER (WHERE priority_v = ''),"
    f" count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_CLEANED} FROM v)) FROM v",
)
def clean_before_after(spark, sf_dir):
    return clean.before_and_after(clean.clean(cells(spark, sf_dir, "messy_orders"), O_TYPES))


@query(
    "clean_summary",
    f"{CHANGES} SELECT (SELECT count(*) FROM v) AS row_count, count(*) AS total_changes_count,"
    f" min({_CONFIDENCE}) AS confidence_score, (SELECT count(*) FROM v) AS post_clean_row_count,"
    " (SELECT count(*) FILTER (WHERE segment_v = '') + count(*) FILTER (WHERE balance_v = '') FROM v)"
    " AS post_clean_missing_value_total FROM changes",
)
def clean_summary(spark, sf_dir):
    return _result(spark, sf_dir).summary.select(
        "row_count", "total_changes_count", "confidence_score", "post_clean_row_count", "post_clean_missing_value_total"
    )
