"""Benchmark passages in cells against a scan of all windows."""

import random

import numpy as np
import pytest

from tidyledger.llm.decontaminate import Winnow, contaminated_cells
from tidyledger.llm.words import grams, hash_memo, word_hashes, words

SCHEMA = "row_index long, note string, cell string, row_key string, marks int, gram long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def entries_of(spark, entries):
    return spark.createDataFrame(entries, "entry_id long, answer string")


def text(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def slow(cell, entries, window):
    own = [w.decode() for w in words((cell or "").encode())]
    hit, ids = set(), set()
    for key, entry in entries:
        theirs = [w.decode() for w in words((entry or "").encode())]
        size = min(window, len(theirs))
        for j in range(len(theirs) - size + 1 if size else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == theirs[j : j + size]:
                    hit |= set(range(i, i + size))
                    ids.add("" if key is None else str(key))
    return len(own), hit, sorted(ids)


@pytest.mark.parametrize("window", [4, 10])
def test_all_windows_are_found(spark, window):
    long, other = text(40, 1), text(30, 2)
    entries = [
        (1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[5:25] + other[:3])), (4, "short entry of five words"),
        (5, "Two, WORDS!"), (6, "x"), (7, None), (8, ""), (9, "..."), (10, " ".join(["again"] * 15)), (None, "no id here"),
        (1, " ".join(text(12, 9))), (12, " ".join(long)),
    ]
    rows = [
        (1, " ".join(text(50, 5) + long[3:30] + text(20, 6))),
        (2, " ".join(long[:9])),
        (3, "-- ".join(w.upper() for w in long[20:40])),
        (4, " ".join(other) + " " + " ".join(other)),
        (5, "before a short entry of five words after"),
        (6, "two words and x"),
        (7, None), (8, ""), (9, "?!"),
        (10, " ".join(["again"] * 30)),
        (11, " ".join(long[:15] + ["gap"] + long[15:])),
        (12, "no id here"), (None, " ".join(long)), (1, " ".join(long)), (14, " ".join(text(12, 9))),
        (15, "é ß " * 20_000 + " ".join(long)),
    ]
    found = contaminated_cells(rows_of(spark, rows), entries_of(spark, entries), "note", "answer", window=window)
    got = []
    for r in found.collect():
        spans = [(s.start, s.stop) for s in r.spans]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        hit = {i for a, b in spans for i in range(a, b)}
        got.append((r.row_index is None, r.row_index or 0, r.n_words, sorted(hit), list(r.entry_ids)))
    expected = [(i is None, i or 0, n, sorted(hit), ids) for i, t in rows for n, hit, ids in [slow(t, entries, window)]]
    assert sorted(got) == sorted(expected)


def test_empty_tables(spark):
    none = contaminated_cells(rows_of(spark, []), entries_of(spark, [(1, "a b c")]), "note", "answer")
    assert none.count() == 0
    clean = contaminated_cells(rows_of(spark, [(1, "a b c")]), entries_of(spark, []), "note", "answer").first()
    assert clean.n_words == 3 and clean.spans == [] and clean.entry_ids == []


def test_every_window_shares_a_fingerprint():
    winnow, memo = Winnow(10), hash_memo()
    shared = [w.encode() for w in text(10, 3, 3)]
    for seed in range(40):
        one = [w.encode() for w in text(seed, seed, 3)] + shared + [b"q"] * seed
        two = [w.encode() for w in text(7, seed + 99, 3)] + shared
        marks = []
        for found in (one, two):
            prints = grams(word_hashes(memo, found), winnow.gram)
            marks.append({int(p) for p in prints[winnow.positions(prints)]})
        assert marks[0] & marks[1]


def test_grams_of_short_runs():
    hashes = np.arange(3, dtype=np.uint64)
    assert len(grams(hashes, 4)) == 0 and len(grams(hashes, 3)) == 1
    assert grams(hashes, 3)[0] != grams(hashes, 3, seed=3)[0]
