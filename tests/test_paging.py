"""Pages of a stored queue against the order of the whole."""

import random

import pytest

from tidyledger.plans import paging, review_queue

SCHEMA = "reference_id string, created_at string, confidence_score double, reason string"


def items(spark):
    draw = random.Random(4)
    made = [(f"i{n:04}", draw.choice(["2000-01-01"] * 6 + [f"2000-02-{d:02}" for d in range(1, 29)]), draw.choice([None, None, 0.5, 0.5, 0.75, draw.random()]), "r") for n in range(1_500)]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


@pytest.mark.parametrize("sort", ["created_at", "confidence_score"])
def test_every_page_is_that_of_the_whole_order(spark, tmp_path, sort):
    path = str(tmp_path / sort)
    paging.store_ordered(items(spark), path, sort, 12)
    whole = items(spark).toPandas().astype(object).where(lambda f: f.notna(), None)
    key = lambda r: (r[sort] is None, r[sort] if r[sort] is not None else 0, r["reference_id"])
    ordered = [r["reference_id"] for r in sorted(whole.to_dict("records"), key=key)]
    for offset in (0, 1, 99, 640, 777, 1_333, 1_450, 1_499, 1_500, 9_000):
        for limit in (1, 50, 100):
            found = [r.reference_id for r in paging.stored_page(spark, path, sort, limit, offset).collect()]
            assert found == ordered[offset : offset + limit], (offset, limit)
    assert paging.total(spark, path).first().total == 1_500
    with pytest.raises(ValueError):
        paging.stored_page(spark, path, sort, 101, 0)


def test_the_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "queue")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    paging.store_ordered(items(spark), path, "created_at", 12)
    plan = paging.stored_page(spark, path, "created_at", 50, 1_300)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThanOrEqual(created_at" in plan
    inside = paging.stored_page(spark, path, "created_at", 10, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(reference_id" in inside
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_an_empty_queue(spark, tmp_path):
    path = str(tmp_path / "none")
    paging.store_ordered(items(spark).limit(0), path)
    assert paging.stored_page(spark, path).count() == 0 and paging.total(spark, path).first().total == 0
