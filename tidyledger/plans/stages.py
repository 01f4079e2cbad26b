"""The five stages end to end: read the approved input, run, write rows, audit logs and one summary row.

The summary row is written last and marks the run as done; a repeated run finds it and does nothing.
Every result waits as ``pending_review`` until it is approved (``plans.review_actions``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger import config
from tidyledger.operators import classify, clean, export, profile, standardize
from tidyledger.operators.match import match
from tidyledger.plans import config_tables
from tidyledger.plans.onerow import beside
from tidyledger.sources import sinks
from tidyledger.sources.csv import CsvScan, read_csv
from tidyledger.sources.tables import CellTable


class GateError(RuntimeError):
    """The input of a run is missing or not approved."""


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str
    organization_id: str

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def read(self, name: str) -> DataFrame | None:
        found = sinks.read_if_present(self.spark, self.table(name))
        return None if found is None else found.where(F.col("organization_id") == self.organization_id)

    def result(self, name: str, task_run_id: str):
        """Summary row of a run, None when there is none."""
        rows = self.read(name)
        return None if rows is None else rows.where(F.col("task_run_id") == task_run_id).first()

    def _stamp(self, frame: DataFrame, task_run_id: str) -> DataFrame:
        return frame.withColumns(
            {"organization_id": F.lit(self.organization_id), "task_run_id": F.lit(task_run_id)}
        )

    def log(self, name: str, frame: DataFrame, task_run_id: str) -> None:
        sinks.append_once(self._stamp(frame, task_run_id), self.table(name))

    def store_rows(self, stage: str, table: CellTable, task_run_id: str) -> DataFrame:
        """Rows as CSV for people and as Parquet for the next stage; returns the file manifest."""
        table.frame.write.mode("overwrite").parquet(self._rows(stage, task_run_id))
        stored = table.with_frame(self.spark.read.parquet(self._rows(stage, task_run_id)))
        path = sinks.write_csv(stored, f"{self.root}/{stage}", self.organization_id, task_run_id)
        return sinks.output_manifest(self.spark, path).withColumn("output_file_path", F.lit(path))

    def load_rows(self, stage: str, task_run_id: str, headers: Sequence[str]) -> CellTable:
        return CellTable(self.spark.read.parquet(self._rows(stage, task_run_id)), tuple(headers))

    def _rows(self, stage: str, task_run_id: str) -> str:
        return f"{self.root}/{stage}_rows/{self.organization_id}/{task_run_id}"

    def finish(
        self, name: str, summary: DataFrame, task_run_id: str, source: str | None, headers: Sequence[str],
        files: DataFrame | None = None,
    ) -> None:
        if files is not None:
            summary = beside(summary, files)
        stamped = summary.withColumns(
            {
                "source_task_run_id": F.lit(source).cast("string"),
                "headers": F.array(*[F.lit(h) for h in headers]),
                "status": F.lit("pending_review"),
                "created_at": F.current_timestamp(),
            }
        )
        self.log(name, stamped, task_run_id)

    def approved(self, name: str, task_run_id: str):
        """Summary row of an approved run; decisions are kept in their own append-only table."""
        row = self.result(name, task_run_id)
        if row is None:
            raise GateError(f"{name} has no result for run {task_run_id}")
        decided = self.read("review_decisions")
        last = None
        if decided is not None:
            mine = decided.where((F.col("task_run_id") == task_run_id) & (F.col("result_table") == name))
            last = mine.orderBy(F.desc("decided_at")).first()
        status = last["status"] if last is not None else row["status"]
        if status != "approved":
            raise GateError(f"input run {task_run_id} is '{status}', not approved")
        return row

    def decide(self, name: str, task_run_id: str, status: str) -> None:
        row = self.spark.range(1).select(
            F.lit(name).alias("result_table"), F.lit(status).alias("status"), F.current_timestamp().alias("decided_at")
        )
        self._stamp(row, task_run_id).write.mode("append").partitionBy("organization_id").parquet(
            self.table("review_decisions")
        )


def run_profile(
    ws: Workspace, path: str, task_run_id: str, limits: config.ScanLimits = config.ScanLimits()
) -> CsvScan | None:
    if ws.result("data_profiles", task_run_id) is not None:
        return None
    scan = read_csv(ws.spark, path, limits)
    ws.store_rows("profiled", scan.table, task_run_id)
    table = ws.load_rows("profiled", task_run_id, scan.table.headers)
    columns = profile.column_profiles(table)
    ws.log("column_profiles", columns, task_run_id)
    stored = ws.read("column_profiles").where(F.col("task_run_id") == task_run_id)
    issues = scan.issues.unionByName(profile.type_issues(stored), allowMissingColumns=True)
    ws.log("structural_issues", issues, task_run_id)
    source = scan.manifest.agg(
        F.sum("size_bytes").alias("source_size_bytes"),
        F.max("encoding").alias("detected_encoding"),
        F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias("source_sha256"),
    ).withColumn("delimiter", F.lit(scan.delimiter))
    digests = F.array_join(F.sort_array(F.collect_list("digest")), ",")
    source = beside(source, scan.fingerprints.agg(digests.alias("source_digest")))
    ws.finish("data_profiles", profile.table_profile(table), task_run_id, None, table.headers, source)
    return scan


def run_clean(ws: Workspace, source_run: str, task_run_id: str, limits: config.AuditLimits = config.AuditLimits()) -> None:
    if ws.result("cleaning_runs", task_run_id) is not None:
        return
    row = ws.result("data_profiles", source_run)
    if row is None:
        raise GateError(f"run {source_run} has no profile")
    table = ws.load_rows("profiled", source_run, row["headers"])
    profiles = ws.read("column_profiles").where(F.col("task_run_id") == source_run)
    types = [r["inferred_type"] for r in profiles.orderBy("position").select("inferred_type").collect()]
    result = clean.clean(table, types, limits)
    files = ws.store_rows("cleaned", result.table, task_run_id)
    ws.log("cleaning_changes", result.changes, task_run_id)
    ws.finish("cleaning_runs", result.summary, task_run_id, source_run, table.headers, files)


def run_standardize(
    ws: Workspace,
    source_run: str,
    task_run_id: str,
    data_source_id: str = "",
    settings: config.StandardizeConfig = config.StandardizeConfig(),
    lookups: config.LookupTables | None = None,
    limits: config.AuditLimits = config.AuditLimits(),
) -> None:
    """Column mappings come from the workspace's tables, and so do lookup entries where none are passed."""
    if ws.result("standardization_runs", task_run_id) is not None:
        return
    headers = ws.approved("cleaning_runs", source_run)["headers"]
    table = ws.load_rows("cleaned", source_run, headers)
    mappings = ws.read("standardization_column_mappings")
    overrides = {}
    if mappings is not None:
        overrides = classify.load_overrides(ws.spark, mappings, ws.organization_id, data_source_id, headers)
    if lookups is None:
        entries = ws.read("standardization_lookup_entries")
        lookups = config.LookupTables() if entries is None else config_tables.load_lookups(entries, ws.organization_id)
    result = standardize.standardize(table, classify.classify_headers(headers, overrides), settings, lookups, limits)
    files = ws.store_rows("standardized", result.table, task_run_id)
    ws.log("standardization_changes", result.changes, task_run_id)
    ws.finish("standardization_runs", result.summary, task_run_id, source_run, headers, files)


def run_match(
    ws: Workspace,
    source_run: str,
    task_run_id: str,
    rules: config.MatchRules | None = None,
    limits: config.MatchLimits = config.MatchLimits(),
    audit: config.AuditLimits = config.AuditLimits(),
    data_source_id: str = "",
) -> None:
    """Where no rules are passed, those of the workspace's rule-set tables apply: the data source's, else the tenant's."""
    if ws.result("match_runs", task_run_id) is not None:
        return
    if rules is None:
        sets, fields = ws.read("match_rule_sets"), ws.read("match_rule_fields")
        if sets is not None and fields is not None:
            rules = config_tables.load_match_rules(sets, fields, ws.organization_id, data_source_id)
    headers = ws.approved("standardization_runs", source_run)["headers"]
    result = match(ws.load_rows("standardized", source_run, headers), rules, limits, audit, task_run_id)
    ws.log("match_groups", result.groups, task_run_id)
    ws.log("match_members", result.members, task_run_id)
    ws.log("match_decisions", result.decisions, task_run_id)
    ws.log("match_skipped_blocks", result.skipped_blocks, task_run_id)
    ws.finish("match_runs", result.summary, task_run_id, source_run, headers)


def run_export(
    ws: Workspace, source_run: str, task_run_id: str, limits: config.AuditLimits = config.AuditLimits()
) -> None:
    if ws.result("export_runs", task_run_id) is not None:
        return
    matched = ws.approved("match_runs", source_run)
    headers = matched["headers"]
    table = ws.load_rows("standardized", matched["source_task_run_id"], headers)
    export.check_row_count(table, matched["row_count"])
    members = ws.read("match_members").where(F.col("task_run_id") == source_run)
    result = export.Export(
        table, members.select("group_id", "canonical_row_index", "record_count", "row_index"), limits
    )
    files = ws.store_rows("exported", result.rows, task_run_id)
    ws.log("export_row_exclusions", result.exclusions, task_run_id)
    summary = result.summary.withColumns(
        {
            "csv_format_version": F.lit(config.EXPORT_FORMAT_VERSION),
            "export_engine_version": F.lit(config.EXPORT_VERSION),
        }
    )
    ws.finish("export_runs", summary, task_run_id, source_run, result.rows.headers, files)
