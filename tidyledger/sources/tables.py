"""Typed and Parquet sources as tables of text cells with a stable row index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from tidyledger.plans.order import offsets

ROW = "row_index"
_TIDY_TYPES = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


@dataclass(frozen=True)
class CellTable:
    """Text cells ``c0..cN`` plus ``row_index``; ``headers`` may repeat or be blank.

    ``tidy`` names cells that cannot hold stray whitespace because they come from numbers or dates.
    """

    frame: DataFrame
    headers: tuple[str, ...]
    tidy: frozenset[str] = frozenset()

    @property
    def cells(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.headers))]

    def position(self, name: str) -> int | None:
        """First column whose trimmed, case-insensitive name matches."""
        wanted = name.strip().lower()
        return next((i for i, h in enumerate(self.headers) if h.strip().lower() == wanted), None)

    def with_frame(self, frame: DataFrame) -> CellTable:
        return CellTable(frame, self.headers)

    def named(self) -> DataFrame:
        """Frame under its display names."""
        cells = [F.col(c).alias(h) for c, h in zip(self.cells, self.headers)]
        return self.frame.select(ROW, *cells)


def from_frame(frame: DataFrame, row_index: str, columns: Sequence[str] | None = None) -> CellTable:
    """Cells of a typed frame as text, indexed by one of its own unique, ordered columns."""
    columns = list(columns) if columns is not None else [c for c in frame.columns if c != row_index]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)]
    tidy = frozenset(f"c{i}" for i, c in enumerate(columns) if isinstance(frame.schema[c].dataType, _TIDY_TYPES))
    return CellTable(frame.select(F.col(row_index).cast("long").alias(ROW), *cells), tuple(columns), tidy)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> CellTable:
    """Parquet files as one table, rows numbered from 0 in file-name order, then file position.

    The counting pass reads no data columns. File offsets are the only thing joined, one row per file.
    """
    raw = spark.read.parquet(path)
    columns = list(columns) if columns is not None else raw.columns
    located = raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_local"), *columns
    )
    starts = offsets(located.groupBy("_file").count(), order=["_file"])
    indexed = located.join(starts.select("_file", "_start"), "_file").withColumn(
        ROW, F.col("_start") + F.col("_local")
    )
    return from_frame(indexed, ROW, columns)


def read_tenant(spark: SparkSession, root: str, organization_id: str) -> DataFrame:
    """Rows of one tenant from a ``organization_id=...`` partitioned root; other partitions are not listed."""
    return spark.read.option("basePath", root).parquet(f"{root}/organization_id={organization_id}")
