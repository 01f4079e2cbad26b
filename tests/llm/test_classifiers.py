"""Held-out accuracy of the classifiers, and their odd inputs."""

import zlib

import pytest

from tidyledger.llm import queries, quality, toxicity

LABELS = "row_index long, verdict int, text string"


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.01"


def accuracy(spark, data, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return rows, [(labels[r.doc_id], r.predicted) for r in held]


def test_quality(spark, data):
    rows, pairs = accuracy(spark, data, "op10_quality_by_random_indexing", "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.95


def test_toxicity(spark, data):
    rows, pairs = accuracy(spark, data, "op1_toxicity_by_compression", "toxic")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    clean = [b for a, b in pairs if a == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.9


@pytest.mark.parametrize("operator", [(toxicity.fit, toxicity.toxic_cells), (quality.fit, quality.good_cells)])
def test_odd_tables(spark, operator):
    fit, score = operator
    texts = [(i, f"good words number {i % 7} in a row") for i in range(40)] + [(100 + i, f"BAD!! {i}!!") for i in range(40)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in texts], "row_index long, note string, score string")
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "a", "x"), (3, "b " * 200_000, "x")], rows.schema)
    no_labels = spark.createDataFrame([], LABELS)
    some = [(i, int(i >= 100), "t") for i, _ in texts] + [(None, 1, "t"), (1, None, "t"), (7777, 1, "t")]
    one_kind = [(i, 1, "t") for i, _ in texts]
    for labels in (no_labels, spark.createDataFrame(some, LABELS), spark.createDataFrame(one_kind, LABELS)):
        model = fit(rows, labels, "note", "verdict")
        found = score(rows.unionByName(odd), "note", model).collect()
        assert len(found) == 85 and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.row_index == 1}) <= 2
    assert score(rows.limit(0), "note", model).count() == 0
    assert fit(rows, spark.createDataFrame(some, LABELS), "note", "verdict", fit_rows=10)
