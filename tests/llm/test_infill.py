"""Fill-in-the-middle cuts against a plain walk over lines, and exact round trips."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidyledger.llm import infill


def slow_cuts(text, one, other):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    low, high = sorted((one % (len(units) + 1), other % (len(units) + 1)))
    return len(units), len("".join(units[:low])), len("".join(units[low:high]))


TEXT = st.text(alphabet=st.sampled_from("ab\n\n\né漢😀\0\x7f\x8a\n"), max_size=70)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=9))
def test_cuts(texts):
    raw = [t.encode() for t, _, _ in texts]
    ends = np.cumsum([len(r) for r in raw])
    draws = [np.array([t[n] for t in texts], np.int64) for n in (1, 2)]
    found = infill.cut_lines(np.frombuffer(b"".join(raw), np.uint8), ends, *draws)
    assert list(zip(*[c.tolist() for c in found])) == [slow_cuts(*t) for t in texts]


def draws(row, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if row is None else row}".encode()).hexdigest()
    return [int(digest[8 * n : 8 * n + 8], 16) for n in range(4)]


def slow(row, text, rate=100, suffix_first=50):
    text, (h1, h2, h3, h4) = text or "", draws(row)
    n, first, second = slow_cuts(text, h1, h2)
    if not text or h3 % 100 >= rate or any(m in text for m in infill.MARKS):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:first], text[first : first + second], text[first + second :]
    if h4 % 100 < suffix_first:
        return n, "spm", first, second, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", first, second, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_odd_tables(spark, monkeypatch):
    texts = [None, "", "\n", "\n\n\n", "a", "é\n漢\n😀", "<P>", "x<M>\ny", "<", "<\n<\nS>", "S>\nM>\n<P", "a\n" * 40_000, "word " * 90_000]
    texts += ["l1\nl2\nl3\nl4\n"] * 30 + [f"{'é' * (n % 9)}\n" * (n % 13) + "😀" * (n % 3) for n in range(120)]
    source = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a\nb", "x", 1), (3, "a\nb\n", "x", 1), (3, "a\nb\n", "x", 1)]
    rows = spark.createDataFrame(source, "row_index long, note string, output string, h1 int").repartition(3)
    for rate, suffix_first in ((100, 50), (40, 0), (0, 50)):
        made = infill.infilled_cells(rows, "note", rate=rate, suffix_first=suffix_first)
        found = made.withColumn("back", infill.restored("output", "form")).drop("row_key").collect()
        told = [(r.row_index, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found]
        wanted = [(i, *slow(i, t, rate, suffix_first), t or "") for i, t, _, _ in source]
        assert sorted(map(repr, told)) == sorted(map(repr, wanted))
    assert infill.infilled_cells(rows.limit(0), "note").count() == 0


def test_blocks_of_any_size(monkeypatch):
    import pyarrow as pa

    texts = ["ab\ncd\n", "", "x" * 50 + "\n\n", "é\n", "end"] * 7
    columns = (pa.array(["skipped", *texts])[1:], pa.array(range(35), pa.int64()), pa.array(range(7, 42), pa.int64()))
    whole = next(infill._cuts(iter([columns]))).to_pylist()
    monkeypatch.setattr(infill, "BLOCK", 20)
    assert next(infill._cuts(iter([columns]))).to_pylist() == whole
    wanted = [slow_cuts(t, i, i + 7) for i, t in enumerate(texts)]
    assert [tuple(w.values()) for w in whole] == wanted
