"""Table and column profiles.

One shuffle on (column, value) feeds type histogram, distinct count and samples; the type of a value is
worked out once per distinct value, not once per cell. Long values travel as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.config import ProfileLimits
from tidyledger.functions.celltype import DOMINANT_SHARE, TYPE_PRIORITY, cell_type
from tidyledger.functions.text import row_key, strip
from tidyledger.sources.tables import ROW, CellTable

# Shorter than the 64 characters of a hex digest, so a short value can never equal a digest.
_SHORT = 63


def _stripped(table: CellTable) -> DataFrame:
    cells = [F.col(c) if c in table.tidy else strip(F.col(c)).alias(c) for c in table.cells]
    return table.frame.select(ROW, *cells)


def _long_cells(table: CellTable) -> DataFrame:
    """One row per non-blank cell: (row_index, cell, value), ``cell`` being the column's position.

    An exploded array, as its exchange can be reused by Spark, which that of an unpivot is not.
    """
    long = _stripped(table).select(ROW, F.posexplode(F.array(*table.cells)).alias("cell", "value"))
    return long.where(F.col("value") != "")


def _distinct_values(table: CellTable) -> DataFrame:
    """(cell, key, long_type, n, first_row) per distinct value."""
    short = F.length("value") <= _SHORT
    keyed = _long_cells(table).select(
        ROW,
        "cell",
        F.when(short, F.col("value")).otherwise(F.sha2("value", 256)).alias("key"),
        F.when(~short, cell_type(F.col("value"))).alias("long_type"),
    )
    return keyed.groupBy("cell", "key", "long_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row")
    )


def _headers(table: CellTable) -> DataFrame:
    rows = [(i, i, h) for i, h in enumerate(table.headers)]
    return table.frame.sparkSession.createDataFrame(rows, "cell int, position int, name string")


def type_counts(table: CellTable) -> DataFrame:
    """(position, value_type, n) histogram of non-blank cells."""
    typed = _distinct_values(table).withColumn("value_type", F.coalesce("long_type", cell_type(F.col("key"))))
    return typed.groupBy(F.col("cell").alias("position"), "value_type").agg(F.sum("n").alias("n"))


def _stats(values: DataFrame) -> DataFrame:
    typed = values.withColumn("value_type", F.coalesce("long_type", cell_type(F.col("key"))))
    per_type = [
        F.coalesce(F.sum(F.when(F.col("value_type") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}")
        for t in TYPE_PRIORITY
    ]
    stats = typed.groupBy("cell").agg(
        F.sum("n").alias("non_null_count"),
        F.count(F.lit(1)).alias("distinct_count"),
        F.min("first_row").alias("first_row"),
        *per_type,
    )
    # Always true; it keeps first_row in use, so that this and _first_seen read one and the same shuffle.
    return judged(stats.where(F.col("first_row").isNotNull()))


def judged(stats: DataFrame) -> DataFrame:
    """Types of columns by the numbers of their non-blank cells of each type, ``n_<type>``."""
    counts = [F.col(f"n_{t}") for t in TYPE_PRIORITY]
    top = F.greatest(*counts)
    stats = stats.withColumn("_top", top)
    ties = sum((F.when(c == F.col("_top"), 1).otherwise(0) for c in counts), F.lit(0))
    dominant = F.coalesce(*[F.when(F.col(f"n_{t}") == F.col("_top"), F.lit(t)) for t in TYPE_PRIORITY])
    mixed = (ties > 1) | (F.col("_top") / F.col("non_null_count") < DOMINANT_SHARE)
    histogram = F.filter(
        F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"n_{t}").alias("n")) for t in sorted(TYPE_PRIORITY)]),
        lambda entry: entry["n"] > 0,
    )
    return stats.select(
        "cell",
        "non_null_count",
        "distinct_count",
        dominant.alias("dominant_type"),
        F.when(mixed, F.lit("mixed")).otherwise(dominant).alias("inferred_type"),
        F.when(mixed, F.col("non_null_count"))
        .otherwise(F.col("non_null_count") - F.col("_top"))
        .alias("inconsistent_value_count"),
        F.map_from_entries(histogram).alias("observed_type_counts"),
    )


def _first_seen(table: CellTable, values: DataFrame, limit: int) -> DataFrame:
    """(cell, rank, value): the first ``limit`` distinct values of each column, in first-seen order.

    Spark keeps the top ``limit`` per task before the shuffle, so no task holds a whole column.
    """
    order = Window.partitionBy("cell").orderBy("first_row")
    # The always-true count test keeps the grouped frame identical to the one _stats reads, so that its
    # shuffle is reused.
    ranked = values.where(F.col("n") > 0).withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= limit)
    digests = ranked.where(F.length("key") > _SHORT).select("cell", F.col("first_row").alias(ROW), "rank")
    # At most ``limit`` rows per column: bounded, so it can be broadcast to fetch the full texts.
    texts = _long_cells(table).join(F.broadcast(digests), ["cell", ROW]).select("cell", "rank", "value")
    short = ranked.where(F.length("key") <= _SHORT).select("cell", "rank", F.col("key").alias("value"))
    return short.unionByName(texts)


def column_samples(table: CellTable, limits: ProfileLimits = ProfileLimits()) -> DataFrame:
    """(position, name, rank, value): retained distinct values in first-seen order."""
    seen = _first_seen(table, _distinct_values(table), max(limits.max_distinct_values, limits.max_sample_values))
    return seen.join(F.broadcast(_headers(table)), "cell").select("position", "name", "rank", "value")


def column_profiles(table: CellTable, limits: ProfileLimits = ProfileLimits()) -> DataFrame:
    """One row per column, in header order."""
    values = _distinct_values(table)
    keep = max(limits.max_distinct_values, limits.max_sample_values)
    samples = (
        _first_seen(table, values, keep)
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_seen"))
        .select("cell", F.col("_seen.value").alias("_seen"))
    )
    row_count = table.frame.agg(F.count(F.lit(1))).scalar()
    missing = F.col("row_count") - F.col("non_null_count")
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    return (
        _headers(table)
        .join(_stats(values), "cell", "left")
        .join(samples, "cell", "left")
        .withColumn("row_count", row_count)
        .withColumn("non_null_count", F.coalesce("non_null_count", zero))
        .withColumn("_seen", F.coalesce("_seen", none))
        .select(
            "name",
            "position",
            F.coalesce("inferred_type", F.lit("null")).alias("inferred_type"),
            "dominant_type",
            "non_null_count",
            missing.alias("missing_count"),
            F.when(F.col("row_count") > 0, F.round(missing / F.col("row_count") * 100, 4))
            .otherwise(F.lit(0.0))
            .alias("missing_percentage"),
            F.coalesce("distinct_count", zero).alias("distinct_count"),
            F.slice("_seen", 1, limits.max_sample_values).alias("sample_values"),
            F.slice("_seen", 1, limits.max_distinct_values).alias("retained_distinct_values"),
            (F.coalesce("distinct_count", zero) > limits.max_distinct_values).alias("distinct_values_truncated"),
            F.coalesce("inconsistent_value_count", zero).alias("inconsistent_value_count"),
            F.coalesce("observed_type_counts", F.create_map().cast("map<string,bigint>")).alias(
                "observed_type_counts"
            ),
        )
        .orderBy("position")
    )


def column_types(table: CellTable) -> DataFrame:
    """(position, inferred_type) only: what cleaning needs from a profile."""
    stats = _stats(_distinct_values(table)).select("cell", "inferred_type")
    return (
        _headers(table)
        .join(stats, "cell", "left")
        .select("position", F.coalesce("inferred_type", F.lit("null")).alias("inferred_type"))
    )


def table_profile(table: CellTable) -> DataFrame:
    """Row, column, duplicate (on trimmed cells) and missing counts of the table."""
    stripped = _stripped(table)
    per_row = F.lit(0)
    for c in table.cells:
        per_row = per_row + F.when(F.col(c) == "", 1).otherwise(0)
    keyed = stripped.select(row_key(table.cells).alias("k"), per_row.alias("missing"))
    # Pre-aggregating by key collapses repeated rows before the shuffle.
    grouped = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(table.headers)).cast("long").alias("column_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_value_total"),
    )


def type_issues(profiles: DataFrame) -> DataFrame:
    """Columns whose cells do not all carry one type."""
    return profiles.where(F.col("inconsistent_value_count") > 0).select(
        F.lit("inconsistent_column_type").alias("type"),
        F.col("position").alias("column_index"),
        F.col("name").alias("column_name"),
        "inferred_type",
        "dominant_type",
        "inconsistent_value_count",
    )
