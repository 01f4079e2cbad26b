"""Structure repair against a search through all edits."""

import functools
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidyledger.llm import queries, repair

NEXT = {"": "us", "s": "u", "u": "a", "a": "u"}


def slow(signs):
    """(cost, audit) by trying every edit at every place of the grammar."""

    @functools.cache
    def best(i, place, inserts):
        options = [(0, "")] if i == len(signs) and place in ("", "a") else []
        if inserts:
            for symbol in NEXT[place].replace("s", ""):
                cost, audit = best(i, symbol, inserts - 1)
                options.append((cost + 2, "I" + audit))
        if i < len(signs):
            sign = signs[i]
            cost, audit = best(i + 1, place, inserts)
            options.append((cost + 3, "D" + audit))
            for symbol in NEXT[place] if sign != "d" else "":
                late = sign.isupper()
                if sign.lower() == symbol:
                    cost, audit = best(i + 1, symbol, inserts)
                    options.append((cost + late, "K" + audit))
                elif symbol != "s":
                    cost, audit = best(i + 1, symbol, inserts)
                    options.append((cost + 2 + late, "R" + audit))
        return min(options, default=(10**9, ""))

    return best(0, "", len(signs) + 2)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="suaxdSUAX", max_size=14))
def test_cost_and_audit(signs):
    assert repair.repair(signs) == slow(signs)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="uaUA", min_size=40, max_size=90))
def test_long_runs(signs):
    assert repair.repair(signs) == slow(signs)


def test_very_long_chat():
    cost, audit = repair.repair("s" + "ua" * 20_000 + "uUad" * 50)
    assert cost == slow("uUad" * 50)[0] and audit[:40_001] == "K" * 40_001


def expected(rows):
    """Query row of one conversation by plain Python; ``rows`` are (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, signs, faults = set(), "", [0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            faults[fault - 1] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signs += "d" if fault in (1, 2) else sign.upper() if fault == 3 else sign
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = slow(signs)
    lines, at, last = [], 0, ""
    for edit in audit:
        if edit != "D":
            role = rows[at][1] if edit == "K" else "assistant" if last == "u" else "user"
            lines.append(role + ":" + ("" if edit == "I" else rows[at][2]))
            last = role[0]
        at += edit != "I"
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(conv, turn, role, text):
    role, text = (" " if v is None else v for v in (role, text))
    key = ":".join(" " if v is None else str(v) for v in (conv, turn))
    kind = zlib.crc32(key.encode()) % 20
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def check(found, source):
    chats = {}
    for conv, turn, role, text in source:
        chats.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[c] for c in names) for r in found}
    assert len(found) == len(chats)
    assert got == {conv: expected(rows) for conv, rows in chats.items()}


def test_query_on_whole_table(spark):
    data = "/root/testdata/sf0.01"
    source = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    check(queries.QUERIES["op12_structure_repair"](spark, data).collect(), source)


def test_odd_tables(spark, tmp_path):
    source = [(c, t, r, x) for c in range(60) for t, r, x in [
        (0, "user", "a."), (None, "user", "b"), (None, None, None), (3, "assistant", " \n\x0b"), (3, "assistant", "c!"),
        (3, "Assistant", "c!"), (9, "system", "s."), (9, "", "x?\t"), (4, "user", "a."), (4, "user", "a."),
    ]]
    source += [(None, 0, "user", "n."), (None, 1, "assistant", "n."), (7777, None, "user", "u."), (8888, 5, None, None)]
    source += [(9999, n, ("user", "assistant")[n % 2], f"{n}.") for n in range(150)]
    schema = "conv_id long, turn long, role string, text string, cost string, rows int"
    frame = spark.createDataFrame([(*r, "clash", 1) for r in source], schema)
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    check(queries.QUERIES["op12_structure_repair"](spark, str(tmp_path)).collect(), source)
    assert repair.repaired_chats(frame.limit(0), "conv_id").count() == 0


@pytest.mark.parametrize("turns, told", [
    ([("user", "hi."), ("assistant", "yes.")], "KK"),
    ([("user", "hi."), ("user", "more."), ("assistant", "yes.")], "KIKK"),
])
def test_turns_are_given_back(spark, turns, told):
    rows = [("c", n, role, text) for n, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "chat_id string, turn int, role string, text string")
    (row,) = repair.repaired_chats(frame).collect()
    assert row.audit == told and [t.role for t in row.turns] == ["user", "assistant"] * (len(row.turns) // 2)
