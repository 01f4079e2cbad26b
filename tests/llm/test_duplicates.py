"""Exact and near duplicates against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidyledger.llm import simhash
from tidyledger.llm.exact import exact_duplicates
from tidyledger.llm.simhash import links, near_duplicates

SCHEMA = "row_index long, note string, cell string, row_key string, best int, print long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2) for i, t in rows], SCHEMA).repartition(5)


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


ROWS = [
    (4, "a b\tc"), (2, "abc"), (9, " a b c "), (7, None), (8, ""), (3, " \n"), (5, "é　x"), (6, "éx"),
    (2, "abc"), (None, "abc"), (None, "only"), (11, "x" * 300_000), (10, "x " * 300_000), (1, "Abc"),
]


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups(spark, fan_in):
    found = exact_duplicates(table(spark, ROWS), "note", fan_in=fan_in).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for index, text in ROWS:
        groups.setdefault(squeezed(text), []).append((-len(text or ""), index is None, index or 0))
    expected = {hashlib.sha256(t.encode()).hexdigest(): (len(g), min(g)) for t, g in groups.items()}
    kept = {}
    for row in found:
        size, (_, unnumbered, index) = expected[row.cell_sha256]
        assert row.group_size == size
        assert row.canonical_row_index == (None if unnumbered else index)
        kept[row.cell_sha256] = kept.get(row.cell_sha256, 0) + row.is_canonical
        assert not row.is_canonical or row.row_index == row.canonical_row_index
    assert set(kept.values()) == {1}


def test_exact_on_an_empty_table_and_on_one_hot_group(spark):
    assert exact_duplicates(table(spark, []), "note").count() == 0
    hot = spark.range(5000).selectExpr("id AS row_index", "IF(id % 3 = 0, 'same', concat('t', id)) AS note")
    found = exact_duplicates(hot.repartition(20), "note").where("canonical_row_index = 0")
    assert found.count() == 1667 and {r[0] for r in found.select("group_size").distinct().collect()} == {1667}


def test_exact_uses_no_python(spark):
    plan = exact_duplicates(table(spark, ROWS), "note")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def slow_fingerprint(text, n=4):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if w]
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(shingles))


def roots(prints, radius):
    """Smallest number reachable over links of at most ``radius`` bits."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return [top(i) for i in range(len(prints))]


def near_rows():
    random.seed(3)
    words = ["w%d" % i for i in range(200)]
    rows = []
    for base in range(12):
        text = [random.choice(words) for _ in range(120)]
        for copy in range(6):
            own = list(text)
            for _ in range(copy):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((base * 10 + copy, " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "Two words"), (904, "two  WORDS"), (905, "one"), (5, "one")]


def test_near_groups(spark):
    rows = near_rows()
    found = near_duplicates(table(spark, rows), "note").collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    tops = roots(prints, 4)
    least = {top: min(rows[i][0] for i, t in enumerate(tops) if t == top) for top in set(tops)}
    expected = sorted((i, format(p, "016x"), least[t]) for (i, _), p, t in zip(rows, prints, tops))
    assert sorted((r.row_index, r.fingerprint, r.canonical_row_index) for r in found) == expected
    assert sum(r.is_canonical for r in found) == len(set(tops))


def test_near_on_an_empty_table_and_a_very_long_text(spark):
    assert near_duplicates(table(spark, []), "note").count() == 0
    text = "a b c d e " * 100_000
    found = near_duplicates(table(spark, [(1, text), (2, text + "f")]), "note").collect()
    assert {r.fingerprint for r in found} == {format(slow_fingerprint(text), "016x")}


@pytest.mark.parametrize("bucket", [8, 4096])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    """Small buckets force the tiled comparison of hot ones."""
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 2**63, 20, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(s) for s in rng.choice(60, 3, replace=False)) for b in bases for _ in range(8)]
    prints = sorted({*map(int, bases), *near, 0, 1, -1, -2})
    found = links(spark.createDataFrame([(p,) for p in prints], "print long"), 4, bucket).collect()
    unsigned = [p % 2**64 for p in prints]
    tops = roots(unsigned, 4)
    place = {p: i for i, p in enumerate(prints)}
    linked = list(range(len(prints)))

    def top(i):
        while linked[i] != i:
            i = linked[i]
        return i

    for a, b in found:
        low, high = sorted((top(place[a]), top(place[b])))
        linked[high] = low
    assert [top(i) for i in range(len(prints))] == tops


def test_masks_never_miss_a_pair():
    for count in (10, 10**6, 10**9, 10**12):
        masks = [m % 2**64 for m in simhash._masks(count, 4)]
        rng = random.Random(count)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)
