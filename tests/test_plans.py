"""Shape of the plans that matter at scale."""

import suite
from tidyledger.config import MatchLimits
from tidyledger.operators import profile
from tidyledger.operators.match import match
from tidyledger.sources.tables import from_frame


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_row_rules_need_no_shuffle(spark, sf_dir):
    for name in ("clean_rows", "std_contact_rows", "std_date"):
        text = plan(suite.QUERIES[name](spark, sf_dir))
        assert "Exchange" not in text and "Join" not in text, name


def test_scans_read_only_the_columns_used(spark, sf_dir):
    text = plan(suite.QUERIES["clean_date"](spark, sf_dir))
    assert "ReadSchema: struct<c_custkey:bigint>" in text
    text = plan(suite.QUERIES["retention_backlog"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_profile_shuffles_distinct_values_once(spark, sf_dir):
    table = from_frame(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    frame = profile.column_profiles(table)
    frame.collect()
    final = plan(frame)
    assert "ReusedExchange" in final
    assert final.count("WindowGroupLimit") >= 2  # samples are cut before their shuffle


def test_no_cross_joins_and_no_row_udfs(spark, sf_dir):
    for name, build in suite.QUERIES.items():
        text = plan(build(spark, sf_dir))
        assert "CartesianProduct" not in text, name
        assert "BatchEvalPython" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_match_totals_form_no_pairs(spark, sf_dir):
    people = suite.base.cells(spark, sf_dir, "people")
    run = match(people, suite.matching.COMPOSITE, MatchLimits(40))
    for frame in (run.block_pairs, run.groups, run.summary):
        joins = [line for line in optimized(frame).split("\n") if "Join " in line]
        assert not any("<" in line for line in joins)  # pairs would be joined on a < b


def test_change_log_reads_only_the_rows_it_needs(spark, sf_dir):
    text = plan(suite.QUERIES["clean_change_log_cap"](spark, sf_dir))
    assert "TakeOrderedAndProject" in text
    assert "Subquery" in text


def test_decisions_join_their_orders_without_a_broadcast(spark, sf_dir):
    """The broadcast table of orders would grow with the input as long as the file is small."""
    from suite import QUERIES

    found = QUERIES["expectations"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.where("table_name = 'match_decisions'").count() > 0
