"""Rule sets and lookups that stages take from tables by scope, and lineage of any depth."""

import random

import pytest

from tidyledger.config import LookupTables, MatchField, MatchRules
from tidyledger.plans import config_tables, lineage, stages


def rule_tables(spark):
    sets = spark.createDataFrame(
        [
            ("r1", "org", None, 1, 0.9, 0.5, True), ("r2", "org", "s1", 1, 0.8, 0.4, False),
            ("r3", "org", "s1", 2, 0.7, 0.3, True), ("r4", "other", "s1", 9, 0.6, 0.2, True),
        ],
        "id string, organization_id string, data_source_id string, version int, duplicate_threshold double,"
        " review_threshold double, is_active boolean",
    )
    fields = spark.createDataFrame(
        [("f2", "r3", "name", "exact", 0.5, "2"), ("f1", "r3", "email", "normalized_exact", 2.0, "1"), ("f3", "r1", "zip", "exact", 1.0, "1")],
        "id string, rule_set_id string, column_name string, comparison_type string, weight double, created_at string",
    )
    return sets, fields


def test_rules_of_a_source_come_before_the_tenants(spark):
    sets, fields = rule_tables(spark)
    own = MatchRules(0.7, 0.3, (MatchField("email", "normalized_exact", 2.0), MatchField("name", "exact", 0.5)))
    assert config_tables.load_match_rules(sets, fields, "org", "s1") == own
    assert config_tables.load_match_rules(sets, fields, "org", "s2") == MatchRules(0.9, 0.5, (MatchField("zip", "exact", 1.0),))
    assert config_tables.load_match_rules(sets, fields, "none", "s1") is None


def test_lookups_by_field_type(spark, monkeypatch):
    entries = spark.createDataFrame(
        [("1", "org", "city", " NYC ", "New York", True), ("2", "org", None, "n.y.", "NY", True), ("3", "org", "city", "la", "LA", False), ("4", "x", None, "a", "b", True)],
        "id string, organization_id string, field_type string, lookup_key string, lookup_value string, is_active boolean",
    )
    assert config_tables.load_lookups(entries, "org") == LookupTables({"city": {"nyc": "New York"}}, {"n.y.": "NY"})
    monkeypatch.setattr(config_tables, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError):
        config_tables.load_lookups(entries, "org")


def test_stages_read_both_tables(spark, tmp_path):
    ws = stages.Workspace(spark, str(tmp_path), "org")
    (tmp_path / "in.csv").write_text("email,country\nA@x.com,Freedonia\na@x.com ,freedonia\nb@x.com,Canada\n")
    sets, fields = rule_tables(spark)
    entries = spark.createDataFrame(
        [("1", "org", "country", "freedonia", "FD", True)],
        "id string, organization_id string, field_type string, lookup_key string, lookup_value string, is_active boolean",
    )
    sets.write.partitionBy("organization_id").parquet(ws.table("match_rule_sets"))
    fields.selectExpr("*", "'org' as organization_id").write.partitionBy("organization_id").parquet(ws.table("match_rule_fields"))
    entries.write.partitionBy("organization_id").parquet(ws.table("standardization_lookup_entries"))
    stages.run_profile(ws, str(tmp_path / "in.csv"), "p1")
    stages.run_clean(ws, "p1", "c1")
    ws.decide("cleaning_runs", "c1", "approved")
    stages.run_standardize(ws, "c1", "s1", "s1")
    rows = ws.load_rows("standardized", "s1", ["email", "country"]).frame.orderBy("row_index").collect()
    assert [r.c1 for r in rows] == ["FD", "FD", "CA"]
    ws.decide("standardization_runs", "s1", "approved")
    stages.run_match(ws, "s1", "m1", data_source_id="s1")
    groups = ws.read("match_groups").collect()
    assert [(r.canonical_row_index, r.record_count) for r in groups] == [(0, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_roots_of_chains_and_cycles(spark, seed):
    draw = random.Random(seed)
    parent = {i: draw.choice([None, i - 1, i - 1, i - 1, max(0, i - draw.randrange(1, 9)), 10_000]) for i in range(1, 300)}
    parent |= {0: None, 500: 501, 501: 502, 502: 500, 503: 502, 504: 504} | {600 + i: 599 + i for i in range(1, 200)} | {600: None}
    rows = [(draw.choice(["a"]), str(i), None if p is None else str(p)) for i, p in parent.items()]
    found = lineage.roots(spark.createDataFrame(rows, "organization_id string, task_run_id string, source_task_run_id string"))

    def slow(i):
        seen, at, depth = {i}, i, 0
        while parent.get(at) is not None and parent[at] in parent:
            at, depth = parent[at], depth + 1
            if at in seen:
                return None, None
            seen.add(at)
        return str(at), depth

    got = {r.task_run_id: (r.root_run_id, r.depth) for r in found.collect()}
    assert got == {str(i): slow(i) for i in parent}


def test_runs_on_a_cycle_take_no_rounds_of_their_own(spark, monkeypatch):
    """Rounds follow the longest chain, not the number of runs."""
    rows = [("a", f"c{i}", None) for i in range(300)] + [("a", f"d{i}", f"c{i}") for i in range(300)]
    rows += [("a", "x", "y"), ("a", "y", "x"), ("a", "z", "x")]
    rounds, attach = [], lineage.attach_group

    def counted(*args):
        rounds.append(args)
        return attach(*args)

    monkeypatch.setattr(lineage, "attach_group", counted)
    found = lineage.roots(spark.createDataFrame(rows, "organization_id string, task_run_id string, source_task_run_id string"))
    got = {r.task_run_id: (r.root_run_id, r.depth) for r in found.collect()}
    want = {f"c{i}": (f"c{i}", 0) for i in range(300)} | {f"d{i}": (f"c{i}", 1) for i in range(300)}
    assert got == want | dict.fromkeys("xyz", (None, None))
    assert len(rounds) == 2
