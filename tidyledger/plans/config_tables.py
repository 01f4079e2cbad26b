"""Versioned rule sets, column mappings and lookup entries as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.config import LookupTables, MatchField, MatchRules

COMPARISONS = ("exact", "normalized_exact")
# A stage's rules become literals of its plan. Larger lookups are joined (``functions.lookups.join_lookup``).
MOST_ENTRIES = 10_000


def latest_rule_sets(rule_sets: DataFrame) -> DataFrame:
    """The highest active version per (tenant, data source); a null data source is a scope of its own."""
    order = Window.partitionBy("organization_id", "data_source_id").orderBy(F.desc("version"))
    active = rule_sets.where("is_active")
    return active.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def rule_set_problems(new_sets: DataFrame, new_fields: DataFrame) -> DataFrame:
    """(id, problem) of rule sets that may not be published."""
    name = F.lower(F.trim("column_name"))
    per_set = new_fields.groupBy(F.col("rule_set_id").alias("id")).agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_distinct(name).alias("names"),
        F.count_if(F.col("weight") <= 0).alias("weightless"),
        F.count_if(~F.col("comparison_type").isin(*COMPARISONS)).alias("unknown"),
        F.count_if(F.trim("column_name") == "").alias("unnamed"),
    )
    low, high = F.col("review_threshold"), F.col("duplicate_threshold")
    problem = (
        F.when(~(low.between(0, 1) & high.between(0, 1)), "threshold_out_of_range")
        .when(low >= high, "review_not_below_duplicate")
        .when(F.col("fields").isNull(), "no_fields")
        .when(F.col("unnamed") > 0, "blank_column_name")
        .when(F.col("unknown") > 0, "unknown_comparison")
        .when(F.col("weightless") > 0, "weight_not_positive")
        .when(F.col("names") < F.col("fields"), "column_twice")
    )
    return new_sets.join(per_set, "id", "left").withColumn("problem", problem).where("problem is not null").select(
        "id", "problem"
    )


def publish_rule_sets(existing: DataFrame, new_sets: DataFrame, new_fields: DataFrame) -> DataFrame:
    """All rule sets after publishing: versions go on per scope, only the newest of a scope stays active.

    ``new_sets`` has an ``created_at`` order; invalid sets are left out (see ``rule_set_problems``).
    """
    good = new_sets.join(rule_set_problems(new_sets, new_fields).select("id"), "id", "left_anti")
    shown = [
        "id", "organization_id", "data_source_id", "version", "duplicate_threshold", "review_threshold",
        "is_active", "created_at",
    ]
    added = good.withColumns({"version": F.lit(None).cast("int"), "is_active": F.lit(True)})
    everything = existing.select(*shown, F.lit(0).alias("_new")).unionByName(added.select(*shown, F.lit(1).alias("_new")))
    scope = Window.partitionBy("organization_id", "data_source_id")
    order = scope.orderBy("_new", "version", "created_at", "id")
    numbered = everything.withColumn("_n", F.row_number().over(order)).withColumn("_any_new", F.max("_new").over(scope))
    last = F.row_number().over(scope.orderBy(F.desc("_new"), F.desc("version"), F.desc("created_at"), F.desc("id"))) == 1
    return numbered.withColumn("_last", last).select(
        "id", "organization_id", "data_source_id",
        F.coalesce("version", F.col("_n")).alias("version"),
        "duplicate_threshold", "review_threshold",
        F.when(F.col("_any_new") == 1, F.col("_last")).otherwise(F.col("is_active")).alias("is_active"),
        "created_at",
    )


def _entry_key(key: str) -> Column:
    return F.lower(F.trim(F.col(key)))


def publish_entries(existing: DataFrame, new: DataFrame, scope: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Mappings or lookups: (accepted, refused). One active entry per (tenant, scope, key), nulls a scope too."""
    order = Window.partitionBy("organization_id", scope, "_key").orderBy("created_at", "id")
    fresh = new.withColumn("_key", _entry_key(key)).withColumn("_rank", F.row_number().over(order))
    taken = (
        existing.where("is_active")
        .select(F.col("organization_id").alias("_o"), F.col(scope).alias("_s"), _entry_key(key).alias("_k"))
        .distinct()
        .withColumn("_taken", F.lit(True))
    )
    same = (F.col("organization_id") == F.col("_o")) & F.col(scope).eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k"))
    judged = fresh.join(taken, same, "left").drop("_o", "_s", "_k")
    free = F.col("_taken").isNull() & (F.col("_rank") == 1)
    helpers = ["_key", "_rank", "_taken"]
    return judged.where(free).drop(*helpers), judged.where(~free).drop(*helpers)


def deactivate(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: the listed ids turn inactive, nothing is removed."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return (
        entries.join(gone, "id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull())
        .drop("_gone")
    )


def active(entries: DataFrame, include_inactive: bool = False) -> DataFrame:
    return entries if include_inactive else entries.where("is_active")


def taken_names(entries: DataFrame, name: str = "name") -> DataFrame:
    """(organization_id, name_key, n): names carried by more than one active entry."""
    return (
        entries.where("is_active")
        .groupBy("organization_id", _entry_key(name).alias("name_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def resolved_rule_sets(rule_sets: DataFrame, sources: DataFrame) -> DataFrame:
    """(organization_id, data_source_id, rule_set_id) for each of the ``sources``: the latest active rule set of the
    data source, else that of the whole tenant, else null."""
    latest = latest_rule_sets(rule_sets).select("organization_id", "data_source_id", F.col("id").alias("_id"))
    own = latest.where(F.col("data_source_id").isNotNull()).withColumnRenamed("_id", "_own")
    wide = latest.where(F.col("data_source_id").isNull()).select("organization_id", F.col("_id").alias("_wide"))
    wanted = sources.select("organization_id", "data_source_id").distinct()
    found = wanted.join(own, ["organization_id", "data_source_id"], "left").join(wide, "organization_id", "left")
    return found.select("organization_id", "data_source_id", F.coalesce("_own", "_wide").alias("rule_set_id"))


def _all_of(rows: DataFrame, what: str) -> list:
    found = rows.limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} {what} in one scope")
    return found


def load_match_rules(
    rule_sets: DataFrame, fields: DataFrame, organization_id: str, data_source_id: str
) -> MatchRules | None:
    """Rules that apply to a data source: its own, else the tenant's, fields in the order of their creation.

    Without any only exact rows match.
    """
    mine = rule_sets.where(F.col("organization_id") == organization_id)
    mine = mine.where(F.col("data_source_id").isNull() | (F.col("data_source_id") == data_source_id))
    latest = latest_rule_sets(mine).orderBy(F.col("data_source_id").isNull()).limit(1).collect()
    if not latest:
        return None
    (chosen,) = latest
    own = fields.where(F.col("rule_set_id") == chosen["id"]).orderBy("created_at", "id")
    found = _all_of(own.select("column_name", "comparison_type", "weight"), "fields")
    return MatchRules(
        float(chosen["duplicate_threshold"]),
        float(chosen["review_threshold"]),
        tuple(MatchField(r["column_name"], r["comparison_type"], float(r["weight"])) for r in found),
    )


def load_lookups(entries: DataFrame, organization_id: str) -> LookupTables:
    """Active lookup entries of a tenant by field type; those without one hold for all types. Keys in lower case."""
    mine = entries.where("is_active").where(F.col("organization_id") == organization_id)
    rows = _all_of(mine.select("field_type", _entry_key("lookup_key").alias("key"), "lookup_value", "id").orderBy("id"), "entries")
    scoped: dict[str, dict[str, str]] = {}
    general: dict[str, str] = {}
    for r in rows:
        table = general if r["field_type"] is None else scoped.setdefault(r["field_type"], {})
        table[r["key"]] = r["lookup_value"]
    return LookupTables(scoped, general)
