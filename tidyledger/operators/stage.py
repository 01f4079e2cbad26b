"""What the row-local stages share: traced values, change capture, totals.

A stage adds one projection level per rule, each level referring to the one below by name, so the value
and its audit come from the same columns and nothing is computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.functions.lookups import literal_map
from tidyledger.functions.text import row_key
from tidyledger.plans.order import first_rows
from tidyledger.sources.tables import ROW, CellTable


@dataclass(frozen=True)
class RuleInfo:
    confidence: float
    reason: str


@dataclass(frozen=True)
class Step:
    """One rule application: the columns before and after, and the rule (or rules by condition) behind it."""

    column: int
    before: str
    after: str
    rules: tuple[tuple[str, Column | None], ...]
    field_type: str | None = None

    @property
    def changed(self) -> Column:
        return F.col(self.after) != F.col(self.before)

    @property
    def rule_name(self) -> Column:
        name = F.lit(self.rules[-1][0])
        for rule, condition in reversed(self.rules[:-1]):
            name = F.when(condition, F.lit(rule)).otherwise(name)
        return name


@dataclass
class Trace:
    """A frame under construction: raw cells, every later level, and the steps between them."""

    table: CellTable
    frame: DataFrame
    registry: dict[str, RuleInfo]
    version: str
    value_name: str
    latest: list[str] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)

    @classmethod
    def start(cls, table: CellTable, registry: dict[str, RuleInfo], version: str, value_name: str) -> Trace:
        return cls(table, table.frame, registry, version, value_name, list(table.cells))

    def level(self, suffix: str, rules: list[tuple[int, Column, tuple, str | None]]) -> None:
        """Add one projection with the new value of each listed column."""
        added = {f"c{i}_{suffix}": value for i, value, _, _ in rules}
        self.frame = self.frame.withColumns(added)
        for i, _, names, field_type in rules:
            after = f"c{i}_{suffix}"
            self.steps.append(Step(i, self.latest[i], after, names, field_type))
            self.latest[i] = after

    def output(self) -> CellTable:
        cells = [F.col(name).alias(cell) for name, cell in zip(self.latest, self.table.cells)]
        return self.table.with_frame(self.frame.select(ROW, *cells))

    def ordered_steps(self, first_column: int | None = None) -> list[Step]:
        """Steps in audit order: by column, ``first_column`` ahead of the rest, then as applied."""
        return sorted(self.steps, key=lambda s: (s.column != first_column, s.column))

    def changes(self, limit: int | None, first_column: int | None = None) -> DataFrame:
        """The audit log in (row, column, step) order, at most ``limit`` rows."""
        steps = self.ordered_steps(first_column)
        events = [
            F.when(
                step.changed,
                F.struct(
                    F.lit(order).alias("step_order"),
                    F.lit(self.table.headers[step.column]).alias("column_name"),
                    F.lit(step.field_type).cast("string").alias("field_type"),
                    F.col(step.before).alias("original_value"),
                    F.col(step.after).alias(self.value_name),
                    step.rule_name.alias("rule_name"),
                ),
            )
            for order, step in enumerate(steps)
        ]
        log = self.frame.select(ROW, F.inline(F.array(*events))).where(F.col("rule_name").isNotNull())
        log = log.withColumn("reason", self._describe("reason")).withColumn(
            "confidence", self._describe("confidence")
        )
        return first_rows(log, ROW, limit, ["step_order"])

    def _describe(self, what: str) -> Column:
        facts = {name: str(getattr(info, what)) for name, info in self.registry.items()}
        found = literal_map(facts)[F.col("rule_name")]
        return found.cast("double") if what == "confidence" else found

    def changes_by_rule(self) -> DataFrame:
        """(rule_name, change_count, confidence): one narrow pass, one partial row per task."""
        counters, names = [], []
        for step in self.steps:
            earlier = F.lit(False)
            for rule, condition in step.rules:
                hit = step.changed & ~earlier & (condition if condition is not None else F.lit(True))
                earlier = earlier | (condition if condition is not None else F.lit(True))
                counters.append(F.count_if(hit).alias(f"n{len(counters)}"))
                names.append(rule)
        totals = self.frame.agg(*counters)
        pairs = F.array(
            *[
                F.struct(F.lit(name).alias("rule_name"), F.col(f"n{k}").alias("n"))
                for k, name in enumerate(names)
            ]
        )
        return (
            totals.select(F.inline(pairs))
            .groupBy("rule_name")
            .agg(F.sum("n").alias("change_count"))
            .where(F.col("change_count") > 0)
            .withColumn("confidence", self._describe("confidence"))
        )

    def summary(self) -> DataFrame:
        """One row: true totals, per-rule counts and the lowest confidence of any applied rule."""
        by_rule = self.changes_by_rule()
        entries = F.sort_array(F.collect_list(F.struct("rule_name", "change_count")))
        return by_rule.agg(
            F.coalesce(F.sum("change_count"), F.lit(0)).alias("total_changes_count"),
            F.map_from_entries(entries).alias("changes_by_rule"),
            F.coalesce(F.min("confidence"), F.lit(1.0)).alias("confidence_score"),
        )


def duplicate_count(table: CellTable) -> DataFrame:
    """(row_count, duplicate_row_count) over untrimmed cells; only 32-byte keys are shuffled."""
    keyed = table.frame.select(row_key(table.cells).alias("k"))
    return keyed.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) - F.count_distinct("k")).alias("duplicate_row_count"),
    )


def missing_count(table: CellTable) -> DataFrame:
    """(missing_value_total): empty cells of the whole table."""
    per_row = F.lit(0)
    for c in table.cells:
        per_row = per_row + F.when(F.col(c) == "", 1).otherwise(0)
    return table.frame.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("missing_value_total"))
