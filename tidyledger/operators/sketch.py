"""Profiles from mergeable sketches: a source is read once, and later profiles merge what was stored of it.

A sketch of a column has a fixed size whatever the number of its values: counts by type, a HyperLogLog sketch of its
distinct values, and the first few of them. Exact profiles (``operators.profile``) move every distinct value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.config import ProfileLimits
from tidyledger.functions.celltype import TYPE_PRIORITY, cell_type
from tidyledger.operators.profile import _headers, _long_cells, _stripped, judged
from tidyledger.sources.tables import ROW, CellTable

PRECISION = 14  # log2 of the registers of a distinct-count sketch: a standard error of 0.8 %
TYPES = [f"n_{t}" for t in TYPE_PRIORITY]


def _first_values(columns: int, keep: int):
    """(cell, first_row, value): the first distinct values of each column within a task, in any order of its rows.

    A value that falls behind the last of ``keep`` may come back by an earlier row; that row is its first one then, as
    those seen before were later than the last kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [pd.Series(dtype="int64")] * columns
        for batch in batches:
            for cell in range(columns):
                own = batch[[ROW, f"c{cell}"]]
                own = own[own[f"c{cell}"] != ""].groupby(f"c{cell}", sort=False)[ROW].min()
                both = own if kept[cell].empty else pd.concat([kept[cell], own]).groupby(level=0, sort=False).min()
                kept[cell] = both.nsmallest(keep)
        for cell, values in enumerate(kept):
            yield pd.DataFrame({"cell": cell, "first_row": values.to_numpy(), "value": values.index.astype(str)})

    return run


def column_sketches(table: CellTable, source: str, limits: ProfileLimits = ProfileLimits()) -> DataFrame:
    """(source, position, name, row_count, non_null_count, n_<type>.., distinct_sketch, samples) per column of a source.

    Each task passes on one sketch and a few values a column; no value is shuffled for being distinct.
    """
    keep = max(limits.max_distinct_values, limits.max_sample_values)
    long = _long_cells(table).withColumn("type", cell_type(F.col("value")))
    counts = long.groupBy("cell").agg(
        F.count(F.lit(1)).alias("non_null_count"),
        F.hll_sketch_agg("value", PRECISION).alias("distinct_sketch"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPE_PRIORITY],
    )
    firsts = _stripped(table).mapInPandas(_first_values(len(table.headers), keep), "cell int, first_row bigint, value string")
    samples = _ranked(firsts.groupBy("cell", "value").agg(F.min("first_row").alias("first")), "cell", keep)
    rows = table.frame.agg(F.count(F.lit(1))).scalar()
    zero = F.lit(0).cast("long")
    found = _headers(table).join(counts, "cell", "left").join(samples, "cell", "left")
    return found.select(
        F.lit(source).alias("source"), "position", "name", F.coalesce(rows, zero).alias("row_count"),
        *[F.coalesce(c, zero).alias(c) for c in ("non_null_count", *TYPES)], "distinct_sketch", "samples",
    )


def _ranked(firsts: DataFrame, column: str, keep: int) -> DataFrame:
    """(column, samples): the first ``keep`` of few values, as array<struct<first, value>> in order."""
    order = Window.partitionBy(column).orderBy("first", "value")
    ranked = firsts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    return ranked.groupBy(column).agg(F.sort_array(F.collect_list(F.struct("first", "value"))).alias("samples"))


def new_sources(stored: DataFrame, sources: list[str]) -> list[str]:
    """The sources of a list that have no sketch yet."""
    known = {r[0] for r in stored.where(F.col("source").isin(sources)).select("source").distinct().collect()}
    return [s for s in sources if s not in known]


def merged_profiles(sketches: DataFrame, limits: ProfileLimits = ProfileLimits()) -> DataFrame:
    """One row per column over all sources, as ``profile.column_profiles`` has it; its distinct_count is an estimate.

    The standard error of the estimate is 0.8 %. First seen is by source, then row. Columns meet by position and name.
    """
    column = ["position", "name"]
    keep = max(limits.max_distinct_values, limits.max_sample_values)
    summed = sketches.groupBy(*column).agg(
        *[F.sum(c).alias(c) for c in ("row_count", "non_null_count", *TYPES)],
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
    )
    cell = F.concat_ws(":", "position", "name").alias("cell")
    stats = judged(summed.where("non_null_count > 0").select("*", cell))
    values = sketches.select(cell, "source", F.inline("samples")).select(
        "cell", F.struct("source", "first").alias("first"), "value"
    )
    firsts = values.groupBy("cell", "value").agg(F.min("first").alias("first"))
    samples = _ranked(firsts, "cell", keep).select("cell", F.col("samples.value").alias("seen"))
    told = summed.select(*column, "row_count", cell).join(stats, "cell", "left").join(samples, "cell", "left")
    zero = F.lit(0).cast("long")
    present = F.coalesce("non_null_count", zero)
    missing = F.col("row_count") - present
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    return told.select(
        "name", "position", F.coalesce("inferred_type", F.lit("null")).alias("inferred_type"), "dominant_type",
        present.alias("non_null_count"), missing.alias("missing_count"),
        F.when(F.col("row_count") > 0, F.round(missing / F.col("row_count") * 100, 4)).otherwise(F.lit(0.0))
        .alias("missing_percentage"),
        F.coalesce("distinct_count", zero).alias("distinct_count"),
        F.slice(seen, 1, limits.max_sample_values).alias("sample_values"),
        F.slice(seen, 1, limits.max_distinct_values).alias("retained_distinct_values"),
        (F.coalesce("distinct_count", zero) > limits.max_distinct_values).alias("distinct_values_truncated"),
        F.coalesce("inconsistent_value_count", zero).alias("inconsistent_value_count"),
        F.coalesce("observed_type_counts", F.create_map().cast("map<string,bigint>")).alias("observed_type_counts"),
    )
