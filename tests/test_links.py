"""The decision log's queries without a block limit hold the blocks that the capped ones leave out."""

import pytest

import suite
from suite import governance, matching
from tidyledger.sources.tables import from_frame


@pytest.mark.parametrize("name", ["match_links_composite", "match_field_comparisons_all", "match_decision_texts_all"])
def test_rows_of_large_blocks_are_logged(spark, monkeypatch, name):
    size = matching.CAP + 20
    rows = [(i, "hot@mail.example", f"name {i % 7}", f"zone {i}") for i in range(size)]
    rows += [(1000 + i, f"rare{i // 2}@mail.example", "name", f"zone {i}") for i in range(10)]
    table = from_frame(spark.createDataFrame(rows, "row_index long, email string, name string, zone string"), "row_index")
    for module in (governance, matching):
        monkeypatch.setattr(module, "_people", lambda *_: table)
    logged = {(r.a, r.b) for r in suite.QUERIES[name](spark, "").collect()}
    by_name = {(i % 7, i) for i in range(7, size)}
    by_key = {(0, i) for i in range(size) if i % 7}
    assert logged == by_name | by_key | {(1000 + i, 1001 + i) for i in range(0, 10, 2)}
