"""Numbering and cutting by an index of any density."""

import random

import pytest
from pyspark.sql import functions as F

from tidyledger.plans import order


def indexes(kind):
    draw = random.Random(1)
    if kind == "dense":
        return list(range(3_000))
    if kind == "hashed":
        return list({draw.randrange(-(2**62), 2**62) for _ in range(3_000)})
    return list(range(2_000)) + [10**15 + 10**9 * n for n in range(1_000)]


@pytest.mark.parametrize("kind", ["dense", "hashed", "two ends"])
def test_numbers_and_heads(spark, kind):
    values = indexes(kind)
    random.Random(2).shuffle(values)
    rows = spark.createDataFrame([(v, str(v)) for v in values], "place bigint, text string").repartition(6)
    numbered = order.number_rows(rows, "place", "n")
    assert {(r.place, r.n) for r in numbered.collect()} == {(v, n) for n, v in enumerate(sorted(values))}
    for limit in (0, 1, 7, 1_500, 2_999, 3_000, 9_999):
        found = [r.place for r in order.first_rows(rows, "place", limit).collect()]
        assert found == sorted(values)[:limit]
    assert order.number_rows(rows.limit(0), "place", "n").count() == 0
    assert order.first_rows(rows.limit(0), "place", 5).count() == 0


def test_no_task_has_much_more_than_the_mean(spark):
    values = indexes("hashed") + list(range(20_000))
    rows = spark.createDataFrame([(v,) for v in values], "place bigint").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rows.repartitionByRange("place").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in dealt]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_repeated_indexes_are_cut_by_the_next_column(spark):
    rows = spark.createDataFrame([(n // 50, n) for n in range(1_000)], "place bigint, step bigint").repartition(5)
    found = [(r.place, r.step) for r in order.first_rows(rows, "place", 120, ["step"]).collect()]
    assert found == [(n // 50, n) for n in range(120)]
