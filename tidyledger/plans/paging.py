"""Pages of a large queue by seeking: an offset becomes a range of the sort key, and only that range is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.plans.order import offsets

RANGES = 200  # parts of a stored queue; a page reads those it touches
ID = "reference_id"
PAGE = 100  # most items of a page


def _order(sort: str) -> list[str]:
    """Columns of the total order: items without a value of the sort column come last, ties end on the id."""
    return ["_missing", sort, ID]


def store_ordered(items: DataFrame, path: str, sort: str = "created_at", ranges: int = RANGES) -> None:
    """Store a queue in the order it is paged in, with a histogram of that order: one row per range.

    Ranges come from sampled quantiles of the whole key, so a value of the sort column that many items share is spread
    over several. Each range is one file, sorted.
    """
    key = _order(sort)
    placed = items.withColumn("_missing", F.col(sort).isNull())
    dealt = placed.repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    dealt.write.mode("overwrite").parquet(f"{path}/items")
    stored = items.sparkSession.read.parquet(f"{path}/items")
    told = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")
    )
    told.write.mode("overwrite").parquet(f"{path}/ranges")


def total(spark: SparkSession, path: str) -> DataFrame:
    """Number of items, from the histogram alone."""
    return spark.read.parquet(f"{path}/ranges").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def stored_page(spark: SparkSession, path: str, sort: str = "created_at", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, at any depth, by reading the ranges it lies in; equal to ordering the whole queue.

    The driver gets the bounds of those ranges, at most one more than a page has items. They go down to the scan as
    filters on the sort column, and on the id where the sort column has one value.
    """
    if not 1 <= limit <= PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{PAGE} and offset not negative")
    ranges = offsets(spark.read.parquet(f"{path}/ranges"), ["low", "high"])
    touched = ranges.where((F.col("_start") < offset + limit) & (F.col("_start") + F.col("count") > offset))
    bounds = touched.orderBy("_start").collect()
    items = spark.read.parquet(f"{path}/items")
    key = _order(sort)
    if not bounds:
        return items.where(F.lit(False)).drop("_missing")
    low, high = bounds[0]["low"], bounds[-1]["high"]
    found = items.where(F.struct(*key) >= _literal(items, low, key)).where(F.struct(*key) <= _literal(items, high, key))
    for column, bound in ((c, (low[c], high[c])) for c in key):
        # What follows a column with more than one value in the range is not bounded by itself.
        if bound[0] is None and bound[1] is None:
            continue
        if bound[0] is None or bound[1] is None:
            break
        found = found.where((F.col(column) >= F.lit(bound[0])) & (F.col(column) <= F.lit(bound[1])))
        if bound[0] != bound[1]:
            break
    return found.orderBy(*key).offset(offset - bounds[0]["_start"]).limit(limit).drop("_missing")


def _literal(items: DataFrame, values, key: list[str]) -> Column:
    return F.struct(*[F.lit(values[c]).cast(items.schema[c].dataType).alias(c) for c in key])
