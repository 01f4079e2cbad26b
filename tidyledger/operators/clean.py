"""Cleaning: squeeze, blank out, coerce every cell; log each change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.config import CLEANING_VERSION, AuditLimits
from tidyledger.functions import numbers, temporal, text, values
from tidyledger.operators import profile
from tidyledger.operators.stage import RuleInfo, Trace, duplicate_count, missing_count
from tidyledger.plans.onerow import beside
from tidyledger.sources.tables import CellTable

# Rule names, confidences and reasons.
RULES = {
    "trim_whitespace": RuleInfo(1.0, "Leading/trailing or repeated internal whitespace removed."),
    "normalize_blank": RuleInfo(0.9, "Blank-equivalent value normalized to a missing value."),
    "coerce_integer": RuleInfo(0.85, "Value coerced to the column's canonical integer form."),
    "coerce_decimal": RuleInfo(0.8, "Value coerced to the column's canonical decimal form."),
    "coerce_boolean": RuleInfo(0.9, "Value coerced to the column's canonical boolean form."),
    "normalize_date_format": RuleInfo(0.7, "Value reparsed into ISO-8601 date/datetime form."),
}

_COERCIONS = {
    "integer": ("coerce_integer", numbers.coerce_integer),
    "decimal": ("coerce_decimal", numbers.coerce_decimal),
    "boolean": ("coerce_boolean", values.boolean),
    "date": ("normalize_date_format", temporal.normalize_date),
    "datetime": ("normalize_date_format", temporal.normalize_date),
}


def coerce(value: Column, inferred_type: str) -> Column:
    """Canonical form of a cell in a column of a known type; other types leave it alone."""
    if inferred_type not in _COERCIONS:
        return value
    return F.when(value == "", value).otherwise(_COERCIONS[inferred_type][1](value))


def check_profile(table: CellTable, column_types: Sequence[str]) -> None:
    if len(column_types) != len(table.headers):
        raise ValueError(
            f"profile describes {len(column_types)} columns but the table has {len(table.headers)}"
        )


@dataclass(frozen=True)
class CleanResult:
    trace: Trace
    limits: AuditLimits

    @property
    def table(self) -> CellTable:
        return self.trace.output()

    @property
    def changes(self) -> DataFrame:
        return self.trace.changes(self.limits.max_changes).drop("field_type")

    @property
    def changes_by_rule(self) -> DataFrame:
        return self.trace.changes_by_rule().select("rule_name", "change_count")

    @property
    def summary(self) -> DataFrame:
        """One row: counts before and after, per-rule totals, lowest confidence, engine version."""
        cleaned = self.table
        after = profile.table_profile(cleaned).select(
            F.col("row_count").alias("post_clean_row_count"),
            F.col("missing_value_total").alias("post_clean_missing_value_total"),
            F.col("duplicate_row_count").alias("post_clean_duplicate_row_count"),
        )
        joined = beside(duplicate_count(cleaned), self.trace.summary(), after)
        return joined.withColumn("cleaning_engine_version", F.lit(CLEANING_VERSION))


def trace_clean(table: CellTable, column_types: Sequence[str]) -> Trace:
    check_profile(table, column_types)
    trace = Trace.start(table, RULES, CLEANING_VERSION, "cleaned_value")
    columns = range(len(table.headers))
    trim, blank = (("trim_whitespace", None),), (("normalize_blank", None),)
    loose = [i for i in columns if f"c{i}" not in table.tidy]
    trace.level("t", [(i, text.squeeze(F.col(trace.latest[i])), trim, None) for i in loose])
    trace.level("b", [(i, values.blank(F.col(trace.latest[i])), blank, None) for i in columns])
    typed = [i for i in columns if column_types[i] in _COERCIONS]
    trace.level(
        "v",
        [
            (i, coerce(F.col(trace.latest[i]), column_types[i]), ((_COERCIONS[column_types[i]][0], None),), None)
            for i in typed
        ],
    )
    return trace


def clean(table: CellTable, column_types: Sequence[str], limits: AuditLimits = AuditLimits()) -> CleanResult:
    """``column_types`` are the profiled types in header order."""
    return CleanResult(trace_clean(table, column_types), limits)


def clean_profiled(table: CellTable, limits: AuditLimits = AuditLimits()) -> CleanResult:
    """Profile first, then clean by the result. The only thing fetched is one type name per column."""
    types = {r["position"]: r["inferred_type"] for r in profile.column_types(table).collect()}
    return clean(table, [types[i] for i in range(len(table.headers))], limits)


def before_and_after(result: CleanResult) -> DataFrame:
    """Table quality before and after: (stage, row_count, missing_value_total, duplicate_row_count)."""
    shown = ["row_count", "missing_value_total", "duplicate_row_count"]
    before = profile.table_profile(result.trace.table).select(F.lit("before").alias("stage"), *shown)
    after = profile.table_profile(result.table).select(F.lit("after").alias("stage"), *shown)
    return before.unionByName(after)


__all__ = ["CleanResult", "before_and_after", "clean", "clean_profiled", "coerce", "missing_count", "trace_clean"]
