import random

import pytest

from tests.brute import match as brute_match
from tidyledger.config import AuditLimits, MatchField, MatchLimits, MatchRules
from tidyledger.operators import export
from tidyledger.operators.components import connected_components
from tidyledger.operators.match import match
from tidyledger.plans import order, skew
from tidyledger.sources.tables import CellTable, from_frame


def cells(spark, rows, headers):
    names = ", ".join(f"h{i} string" for i in range(len(headers)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_index bigint, {names}")
    table = from_frame(frame, "row_index")
    return type(table)(table.frame, tuple(headers))


def messy_rows(seed, n):
    rng = random.Random(seed)
    rows = [
        [
            rng.choice(["", " A@x.com", "a@x.com", "b@x.com", "B@X.COM ", "c@x.com", "d@x.com"]),
            rng.choice(["Ann", "ann", "Bob", ""]),
            rng.choice(["1", "2"]),
        ]
        for _ in range(n)
    ]
    return rows


RULES = [
    None,
    MatchRules(0.9, 0.4, (MatchField("email"),)),
    MatchRules(0.9, 0.4, (MatchField("email"), MatchField("name", weight=0.3))),
    MatchRules(0.7, 0.5, (MatchField("email"), MatchField("name", weight=0.3))),
    MatchRules(0.7, 0.4, (MatchField("email", weight=2.0), MatchField("name"), MatchField("zone"))),
    MatchRules(0.8, 0.3, (MatchField("email", "exact", 2.0), MatchField("name"), MatchField("zone"))),
    MatchRules(0.6, 0.2, (MatchField("name", "exact", 1.0), MatchField("nowhere", "exact", 0.5))),
    MatchRules(0.6, 0.2, (MatchField("missing", weight=3.0), MatchField("name"))),
]


@pytest.mark.parametrize("number,cap", [(i, 6 if i % 2 else 1000) for i in range(len(RULES))] + [(4, 6), (5, 1000)])
def test_against_brute_force(spark, number, cap):
    rules = RULES[number]
    headers = ["Email", "name", "zone"]
    rows = messy_rows(number, 60)
    expected = brute_match(rows, headers, rules, cap, 3)
    got = match(cells(spark, rows, headers), rules, MatchLimits(cap, 3))
    log = [
        (r.record_a_row_index, r.record_b_row_index, r.blocking_key, r.decision, round(r.total_score, 9))
        for r in got.decisions.collect()
    ]
    assert sorted(log, key=str) == sorted([(*d[:4], round(d[4], 9)) for d in expected["decisions"]], key=str)
    groups = {r.canonical_row_index: (r.record_count, r.confidence_score) for r in got.groups.collect()}
    assert groups == expected["groups"]
    members = {(r.canonical_row_index, r.row_index) for r in got.members.collect()}
    assert members == expected["members"]
    skipped = [(r.blocking_key, r.block_size, r.sample_row_indices) for r in got.skipped_blocks.collect()]
    assert sorted(skipped) == expected["skipped"]
    summary = got.summary.first()
    assert summary.row_count == len(rows)
    assert summary.total_comparisons_count == expected["comparisons"]
    assert summary.duplicate_pairs_count == expected["duplicates"]
    assert summary.ambiguous_pairs_count == expected["ambiguous"]
    assert summary.duplicate_group_count == len(expected["groups"])
    assert summary.skipped_block_count == len(expected["skipped"])
    assert summary.confidence_score == min([s for _, s in expected["groups"].values()], default=1.0)


@pytest.mark.parametrize("number", [1, 3, 5])
def test_uncapped_blocks(spark, number):
    headers = ["Email", "name", "zone"]
    rows = messy_rows(number + 50, 60)
    expected = brute_match(rows, headers, RULES[number], 10**9)
    got = match(cells(spark, rows, headers), RULES[number], MatchLimits(None))
    assert {r.canonical_row_index: (r.record_count, r.confidence_score) for r in got.groups.collect()} == expected["groups"]
    assert got.summary.first().duplicate_pairs_count == expected["duplicates"]
    # Without a size limit the log has links that connect the groups, each a pair of the full log with its score.
    pairs = {(d[0], d[1]): (d[3], round(d[4], 9)) for d in expected["decisions"]}
    links = got.field_decisions.collect()
    assert all(pairs[(r.a, r.b)] == (r.decision, round(r.total_score, 9)) for r in links)
    assert len(links) <= 4 * len(rows)
    assert all(r.complete for r in export.rebuild_membership(got.decisions, got.groups).collect())


@pytest.mark.parametrize("fields,cap", [(8, None), (16, 9)])
def test_many_fields_against_brute_force(spark, fields, cap):
    rng = random.Random(fields)
    headers = [f"h{i}" for i in range(fields)]
    rows = [[rng.choice(["x", "y", "z", ""])] + [rng.choice("ab") for _ in headers[1:]] for _ in range(50)]
    rows += [list(rows[0]), [rows[1][0], *rows[2][1:]], [" X ", *rows[0][1:]]]
    spec = [MatchField("h0", weight=3.0)] + [MatchField(h, "exact" if i % 2 else "normalized_exact", 1 + i % 3) for i, h in enumerate(headers[1:])]
    rules = MatchRules(0.75, 0.6, tuple(spec))
    expected = brute_match(rows, headers, rules, cap or 10**9, 20)
    got = match(cells(spark, rows, headers), rules, MatchLimits(cap))
    assert {r.canonical_row_index: (r.record_count, round(r.confidence_score, 9)) for r in got.groups.collect()} == {
        k: (n, round(c, 9)) for k, (n, c) in expected["groups"].items()
    }
    s = got.summary.first()
    assert (s.total_comparisons_count, s.duplicate_pairs_count, s.ambiguous_pairs_count) == (
        expected["comparisons"], expected["duplicates"], expected["ambiguous"],
    )
    pairs = {(d[0], d[1]): (d[3], round(d[4], 9)) for d in expected["decisions"]}
    log = {(r.a, r.b): (r.decision, round(r.total_score, 9)) for r in got.field_decisions.collect()}
    assert all(pairs[k] == v for k, v in log.items())
    assert cap is None or log == {(d[0], d[1]): pairs[d[0], d[1]] for d in expected["decisions"] if d[2]}


def test_a_large_block_is_matched_by_default(spark):
    rows = [["same@x.com", f"n{i}", "1"] for i in range(1500)]
    got = match(cells(spark, rows, ["email", "name", "zone"]), RULES[1])
    assert [(r.canonical_row_index, r.record_count) for r in got.groups.collect()] == [(0, 1500)]
    assert got.members.count() == 1500 and got.field_decisions.count() == 1499
    assert got.summary.first().duplicate_pairs_count == 1500 * 1499 // 2


def test_log_is_cut_in_order_and_totals_are_not(spark):
    headers = ["Email", "name", "zone"]
    rows = messy_rows(3, 60)
    table = cells(spark, rows, headers)
    limits = MatchLimits.published()
    full = match(table, RULES[3], limits).decisions.collect()
    cut = match(table, RULES[3], limits, AuditLimits(max_decisions=25))
    first = {(r.record_a_row_index, r.record_b_row_index, r.blocking_key) for r in cut.decisions.collect()}
    chains = sorted(
        (r for r in full if r.blocking_key is None),
        key=lambda r: (rows.index(rows[r.record_a_row_index]), r.record_a_row_index),
    )
    pairs = sorted(
        (r for r in full if r.blocking_key), key=lambda r: (r.blocking_key, r.record_a_row_index, r.record_b_row_index)
    )
    wanted = (chains + pairs)[:25]
    assert first == {(r.record_a_row_index, r.record_b_row_index, r.blocking_key) for r in wanted}
    assert cut.summary.first() == match(table, RULES[3], limits).summary.first()


def test_decision_reason_and_comparison(spark):
    table = cells(spark, [["a@x", "Ann", "1"], ["A@x ", "Bob", "1"]], ["email", "name", "zone"])
    row = match(table, RULES[3]).decisions.first()
    assert row.decision == "duplicate" and row.rule_name == "composite_weighted_match"
    assert row.reason == "1 of 2 configured fields matched (score 0.7692 >= threshold 0.7000)"
    assert row.field_comparisons["name"].asDict() == {
        "value_a": "ann", "value_b": "bob", "matched": False, "weight": 0.3, "contribution": 0.0,
    }


def test_export_and_membership(spark):
    headers = ["Email", "name", "zone"]
    rows = messy_rows(3, 60)
    table = cells(spark, rows, headers)
    run = match(table, RULES[3])
    out = export.Export(table, run.members, AuditLimits.published())
    gone = {i for k, i in brute_match(rows, headers, RULES[3])["members"] if i != k}
    survivors = {int(r[f"c{4}"]): r for r in out.rows.frame.collect()}
    assert set(survivors) == set(range(60)) - gone
    assert all(r["c3"] == "True" for r in survivors.values())
    log = out.exclusions.collect()
    assert [r.row_index for r in log] == sorted(gone)
    s = out.summary.first()
    assert (s.source_row_count, s.row_count, s.excluded_row_count) == (60, 60 - len(gone), len(gone))
    assert s.output_column_count == 5
    assert all(r.complete for r in export.rebuild_membership(run.decisions, run.groups).collect())
    short = match(table, RULES[3], audit=AuditLimits(max_decisions=2))
    assert not all(r.complete for r in export.rebuild_membership(short.decisions, short.groups).collect())
    with pytest.raises(ValueError):
        export.Export(cells(spark, [["x"]], ["__dq_canonical_record"]), run.members)
    with pytest.raises(ValueError):
        export.check_row_count(table, 61)


def test_components_of_any_shape(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    expected = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.root for r in connected_components(frame).collect()} == expected


def test_hot_groups_take_the_broadcast_path(spark):
    rows = spark.range(100).selectExpr("id", "case when id < 60 then 'hot' else concat('k', id % 7) end as k")
    groups = rows.groupBy("k").count()
    plain = sorted(rows.join(groups, "k").select("id", "k", "count").collect())
    split = skew.attach_group(rows, groups, "k", "count", hot_rows=20, max_hot=1)
    assert sorted(split.select("id", "k", "count").collect()) == plain
    assert skew.without_hot(rows, groups, "k", "count", hot_rows=20).count() == 40


def test_order_helpers(spark):
    rows = spark.range(0, 100, 3).selectExpr("id as row_index", "cast(id % 2 as string) as g", "id as x")
    got = order.first_rows(rows, "row_index", 5, bucket_rows=10).collect()
    assert [r.row_index for r in got] == [0, 3, 6, 9, 12]
    numbered = order.number_rows(rows, "row_index", "pos", bucket_rows=10).orderBy("row_index").collect()
    assert [r.pos for r in numbered] == list(range(34))
    linked = order.next_in_group(rows, "g", "row_index", "nxt", bucket_rows=10).collect()
    for r in linked:
        later = [i for i in range(0, 100, 3) if i > r.row_index and i % 2 == int(r.g)]
        assert r.nxt == (later[0] if later else None)


@pytest.mark.parametrize("rules", [RULES[2], MatchRules(0.7, 0.5, (MatchField("email", weight=3.0), *(MatchField(f"k{i}") for i in range(8))))])
def test_blocks_of_one_row_have_no_pairs(spark, rules):
    rows = [["a@x.com", "n", "1"], ["A@x.com ", "m", "1"], ["alone@x.com", "n", "1"], ["twin@x.com", "n", "1"]] + [["twin@x.com", "n", "1"]]
    pairs = match(cells(spark, rows, ["email", "name", "zone"]), rules).block_pairs.collect()
    assert [(r.block_key, int(r.comparisons)) for r in pairs] == [("a@x.com", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_large_blocks_take_rounds_with_the_same_result(spark, monkeypatch, seed):
    from tidyledger.operators import match as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 4)
    headers, rows = ["email", "name", "zone"], messy_rows(seed + 70, 70)
    rules = MatchRules(0.7, 0.4, (MatchField("email", weight=2.0), MatchField("name"), MatchField("zone")))
    expected = brute_match(rows, headers, rules, 10**9)
    got = match(cells(spark, rows, headers), rules)
    assert {r.canonical_row_index: (r.record_count, r.confidence_score) for r in got.groups.collect()} == expected["groups"]
    assert got.members.count() == len(expected["members"])


@pytest.mark.parametrize("held", [1_000_000, 10])
def test_chain_over_all_partitions(spark, monkeypatch, held):
    from tidyledger.operators import components

    monkeypatch.setattr(components, "FOREST_LINKS", held)
    links = [(i, i + 1) for i in range(400)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(links)
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(9)
    found = {r.node: r.root for r in connected_components(frame).collect()}
    assert found == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(300)}


@pytest.mark.parametrize("fields,low,high", [(8, 0.6, 0.8), (12, 0.45, 0.7), (12, 0.05, 0.3), (10, 1.0, 1.0)])
def test_lists_of_rare_values_lose_no_pair(spark, monkeypatch, fields, low, high):
    from tidyledger.operators import match as module

    monkeypatch.setattr(module, "TUPLES", 7)
    rng = random.Random(fields)
    headers = [f"h{i}" for i in range(fields)]
    rows = [["k"] + [rng.choice(["a", "b", ""] if i % 3 else ["a", *map(str, range(9))]) for i in range(1, fields)] for _ in range(70)]
    rows += [[*rows[n][: n % fields], *rows[n + 1][n % fields :]] for n in range(30)] + [["z", *rows[0][1:]], ["z", *rows[1][1:]]]
    spec = [MatchField("h0", weight=1.5)] + [MatchField(h, weight=0.5 + i % 4) for i, h in enumerate(headers[1:])]
    rules = MatchRules(high, low, tuple(spec))
    expected = brute_match(rows, headers, rules, 10**9, 20)
    got = match(cells(spark, rows, headers), rules)
    s = got.summary.first()
    assert (s.total_comparisons_count, s.duplicate_pairs_count, s.ambiguous_pairs_count) == (
        expected["comparisons"], expected["duplicates"], expected["ambiguous"],
    )
    groups = {r.canonical_row_index: (r.record_count, round(r.confidence_score, 9)) for r in got.groups.collect()}
    assert groups == {k: (n, round(c, 9)) for k, (n, c) in expected["groups"].items()}


def test_pairs_looked_at_grow_below_the_square(spark):
    """A block's tuples with names, numbers and some fields of few values: joined rows per tuple do not grow with it."""
    rules = MatchRules(0.8, 0.6, (MatchField("h0", weight=2.0), *(MatchField(f"h{i}") for i in range(1, 9))))
    looked = []
    for size in (500, 4_000):
        rng = random.Random(4)
        rows = [["k"] + [str(rng.randrange(size)) for _ in range(5)] + [rng.choice("ab") for _ in range(3)] for _ in range(size)]
        lists = match(cells(spark, rows, [f"h{i}" for i in range(9)]), rules)._lists
        looked.append(lists.groupBy("block_key", "field", "value").count().selectExpr("sum(count * count)").first()[0] / size)
    assert looked[1] < 3 * looked[0] and looked[1] < 40


def test_pair_counts_hold_one_level_of_field_sets_at_a_time(spark):
    """Levels are stored: no task works out the aggregations of all of them, whose memory it holds to its end."""
    rows = [(i, "k", str(i % 2), str(i % 3)) for i in range(12)]
    table = from_frame(spark.createDataFrame(rows, "row_index long, key string, p string, q string"), "row_index")
    fields = (MatchField("key", weight=1.0), MatchField("p", weight=0.3), MatchField("q", weight=0.3))
    counts = match(table, MatchRules(0.7, 0.4, fields), MatchLimits(40)).block_pairs
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 2
    assert [tuple(r) for r in counts.collect()] == [("k", 15, 9, 6)]


def test_tuples_of_small_blocks_are_not_listed(spark, monkeypatch):
    """Blocks a task can hold are compared in one shuffle by block: lists of their values took most of the disk."""
    from tidyledger.operators import match as module

    rng = random.Random(9)
    headers = [f"h{i}" for i in range(9)]
    rows = [[f"k{rng.randrange(12)}"] + [rng.choice("ab") for _ in range(8)] for _ in range(90)] + [["K0", *"aaaaaaaa"]] * 2
    rules = MatchRules(0.75, 0.5, (MatchField("h0", weight=3.0), *(MatchField(h) for h in headers[1:])))
    expected = brute_match(rows, headers, rules, 10**9, 20)
    monkeypatch.setattr(module.Match, "_lists_of", lambda *_: pytest.fail("listed"))
    pairs = match(cells(spark, rows, headers), rules).block_pairs
    found = pairs.selectExpr("sum(duplicates)", "sum(ambiguous)").first()
    exact = sum(d[4] == 1 and rows[d[0]] == rows[d[1]] for d in expected["decisions"])
    assert (int(found[0]) + exact, int(found[1])) == (expected["duplicates"], expected["ambiguous"])
    shuffles = pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block_key")
    assert shuffles <= 2


def test_tuples_without_or_of_one_row_index(spark):
    """Two tuples of one index are no pair; rows without an index are counted, and are in no pair."""
    table = spark.createDataFrame(
        [(1, "k", *"aaaaaaaa"), (1, "k", *"aaaaaaab"), (2, "k", *"aaaaaabb"), (None, "k", *"abababab")],
        "row_index bigint, " + ", ".join(f"c{i} string" for i in range(9)),
    )
    headers = tuple(f"h{i}" for i in range(9))
    rules = MatchRules(0.75, 0.5, (MatchField("h0", weight=3.0), *(MatchField(h) for h in headers[1:])))
    row = match(CellTable(table, headers), rules).block_pairs.first()
    assert (int(row.comparisons), int(row.duplicates), int(row.ambiguous)) == (6, 2, 0)
