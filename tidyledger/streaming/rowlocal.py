"""Cleaning and standardization over a stream: both look at one row at a time, so the batch code runs as is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidyledger.config import LookupTables, StandardizeConfig
from tidyledger.operators.clean import trace_clean
from tidyledger.operators.standardize import standardize
from tidyledger.sources.tables import from_frame


def clean_stream(stream: DataFrame, row_index: str, column_types: Sequence[str]) -> DataFrame:
    return trace_clean(from_frame(stream, row_index), column_types).output().named()


def standardize_stream(
    stream: DataFrame,
    row_index: str,
    field_types: Sequence[str | None],
    config: StandardizeConfig = StandardizeConfig(),
    tables: LookupTables = LookupTables(),
) -> DataFrame:
    return standardize(from_frame(stream, row_index), field_types, config, tables).table.named()


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, exactly once, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
