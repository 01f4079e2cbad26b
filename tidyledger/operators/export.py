"""Deduplicated output of a matching run, with provenance and an exclusion log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.config import EXPORT_VERSION, AuditLimits
from tidyledger.plans.order import first_rows
from tidyledger.sources.tables import ROW, CellTable

CANONICAL_COLUMN = "__dq_canonical_record"
SOURCE_ROW_COLUMN = "__dq_source_row_index"
RESERVED = (CANONICAL_COLUMN, SOURCE_ROW_COLUMN)


def reserved_collisions(headers: tuple[str, ...]) -> list[str]:
    return [h for h in headers if h in RESERVED]


@dataclass(frozen=True)
class Export:
    """``members(group_id, canonical_row_index, record_count, row_index)`` decides which rows go."""

    table: CellTable
    members: DataFrame
    limits: AuditLimits = AuditLimits()

    def __post_init__(self) -> None:
        taken = reserved_collisions(self.table.headers)
        if taken:
            raise ValueError(f"input already has reserved columns: {', '.join(taken)}")

    @property
    def dropped(self) -> DataFrame:
        return self.members.where(F.col(ROW) != F.col("canonical_row_index"))

    @property
    def rows(self) -> CellTable:
        """Surviving rows, two provenance cells appended. Joined on the unique row index: no key is hot."""
        kept = self.table.frame.join(self.dropped.select(ROW), ROW, "left_anti")
        n = len(self.table.headers)
        cells = {f"c{n}": F.lit("True"), f"c{n + 1}": F.col(ROW).cast("string")}
        return CellTable(kept.withColumns(cells), self.table.headers + RESERVED)

    @property
    def exclusions(self) -> DataFrame:
        """(row_index, match_group_id, canonical_row_index, reason, rule_version) in row order, up to the cap."""
        log = self.dropped.select(
            ROW,
            F.col("group_id").alias("match_group_id"),
            "canonical_row_index",
            F.format_string(
                "row %d excluded: member of duplicate group (canonical row_index=%d, %d members)",
                F.col(ROW), F.col("canonical_row_index"), F.col("record_count"),
            ).alias("reason"),
            F.lit(EXPORT_VERSION).alias("rule_version"),
        )
        return first_rows(log, ROW, self.limits.max_exclusions)

    @property
    def summary(self) -> DataFrame:
        source = self.table.frame.agg(F.count(F.lit(1))).scalar()
        canonical = F.col(ROW) == F.col("canonical_row_index")
        counted = self.members.agg(
            F.count_if(~canonical).alias("excluded_row_count"),
            F.count_if(canonical).alias("duplicate_groups_materialized_count"),
        )
        return counted.withColumn("source_row_count", source).select(
            "source_row_count",
            (F.col("source_row_count") - F.col("excluded_row_count")).alias("row_count"),
            "excluded_row_count",
            "duplicate_groups_materialized_count",
            F.lit(len(self.table.headers) + len(RESERVED)).alias("output_column_count"),
        )


def check_row_count(table: CellTable, expected: int) -> None:
    """The table must still have the rows the matching run saw."""
    found = table.frame.count()
    if found != expected:
        raise ValueError(f"table has {found} rows but the matching run saw {expected}")


def rebuild_membership(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """Membership as the decision log tells it, against each group's own record count.

    (group_id, canonical_row_index, record_count, member_count, complete): a log that was cut short shows
    up as an incomplete group. Members are counted, never collected.
    """
    linked = decisions.where("decision = 'duplicate'").select(
        F.col("match_group_id").alias("group_id"),
        F.explode(F.array("record_a_row_index", "record_b_row_index")).alias("member"),
    )
    own = groups.select("group_id", F.col("canonical_row_index").alias("member"))
    counted = (
        linked.unionByName(own).distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))
    )
    return groups.join(counted, "group_id").select(
        "group_id",
        "canonical_row_index",
        "record_count",
        "member_count",
        (F.col("member_count") == F.col("record_count")).alias("complete"),
    )
