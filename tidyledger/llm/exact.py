"""Exact duplicates of a cell: sorted digest runs merged up a tree, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, cut, keyed

# The characters that two equal cells may differ in.
BLANKS = " \t\n\x0b\x0c\r"


def squeezed(cell: Column | str) -> Column:
    """Cell without any blank character."""
    return F.translate(cell, BLANKS, "")


def exact_duplicates(
    rows: DataFrame, cell: str, row_index: str = ROW, row_key: str | None = None, fan_in: int = 8
) -> DataFrame:
    """Rows whose cells are equal but for blanks, as match groups with one canonical row.

    Returns one row per row of the table: (row_key, row_index, canonical_row_index, group_size, is_canonical,
    cell_sha256). The canonical row has the longest original cell, then the smallest row_index (rows without one
    come last), then the smallest row_key. Missing cells equal empty and blank ones and form a group like any other.
    A repeated row is a further member of its group; exactly one row of a group is canonical. An empty table gives
    no rows. Other columns of the table are not read.

    Each input partition is one run of (digest, best row, count). A round sends ``fan_in`` neighbouring runs to one
    merged run, split over tasks by digest; Spark combines rows of a digest before they are sent and merges the
    sorted rest, so a digest held by a third of all rows arrives as at most one row per run. Digests are verified
    at every level by a second independent hash and the length of the squeezed cell. After the last round one row
    per distinct cell is joined back to the stored digests, where adaptive execution splits a large group.
    """
    text = squeezed(CELL)
    digests = cut(
        keyed(rows, cell, row_index, row_key).select(
            KEY,
            ROW,
            F.length(CELL).alias("chars"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.xxhash64(text, F.length(text)).alias("proof"),
            F.spark_partition_id().alias("run"),
        )
    )
    rank = F.struct(
        (-F.col("chars")).alias("shorter"), F.col(ROW).isNull().alias("unnumbered"), F.col(ROW).alias(ROW), KEY
    )
    merged = digests.select("run", "digest", "proof", rank.alias("best"), F.lit(1).cast("long").alias("size"))
    last = digests.agg(F.max("run")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log(last + 1, fan_in) - 1e-9))):
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest", "proof")
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
    groups = merged.select("digest", "proof", "best", "size")
    return digests.join(groups, ["digest", "proof"]).select(
        KEY,
        digests[ROW],
        F.col(f"best.{ROW}").alias("canonical_row_index"),
        F.col("size").alias("group_size"),
        (F.col(f"best.{KEY}") == digests[KEY]).alias("is_canonical"),
        F.lower(F.hex("digest")).alias("cell_sha256"),
    )
