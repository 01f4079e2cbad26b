"""What all operators on free-text cells share: the rows they read and the cut in a long lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.session import ensure_checkpoint_dir

KEY = "row_key"
ROW = "row_index"
CELL = "cell"


def keyed(rows: DataFrame, cell: str, row_index: str = ROW, row_key: str | None = None) -> DataFrame:
    """(row_key, row_index, cell) of a table; no other column is read, so their names never clash.

    ``row_key`` numbers the rows of the input unless a column of unique numbers is named. A missing cell is ''.
    """
    number = rows[row_key].cast("long") if row_key else F.monotonically_increasing_id()
    return rows.select(
        number.alias(KEY),
        rows[row_index].cast("long").alias(ROW),
        F.coalesce(rows[cell].cast("string"), F.lit("")).alias(CELL),
    )


def first_row() -> Column:
    """Sort key of the row that speaks for a group: smallest row_index, rows without one last, then row_key."""
    return F.struct(F.col(ROW).isNull().alias("none"), F.col(ROW).alias(ROW), F.col(KEY).alias(KEY))


def cut(frame: DataFrame) -> DataFrame:
    """Rows stored in the shared checkpoint folder: later jobs start there, whatever executor is lost."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()

