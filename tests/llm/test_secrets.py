"""Secret spans and their ownership against plain Python."""

import random
import re

import pytest

from tidyledger.llm import secrets

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile("[0-9a-f]+"), 24),
}


def base(text):
    found = []
    for rank, (kind, (pattern, least)) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= least:
                found.append((m.start(), rank, m.end(), kind, value))
    return sorted(found)


def tokens(text, known):
    for m in re.finditer("[A-Za-z0-9+_=-]{20,}", text):
        drawn = all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]")) and len(set(m[0])) >= 12
        if drawn and not any(s <= m.start() < e for s, _, e, _, _ in known):
            yield m.start(), 3, m.end(), "owned", m[0]


def slow(rows, copied=3):
    found, owners, pairs, counts, named = [], {}, {}, {}, set()
    for _, text, source, owner in rows:
        known = base(text or "")
        own = sorted(known + list(tokens(text or "", known)))
        found.append(own)
        for _, _, _, kind, value in own:
            owners.setdefault(value, set()).add(owner)
            pairs.setdefault(value, set()).add((owner, source))
            counts[value] = counts.get(value, 0) + 1
            if kind != "owned":
                named.add(value)
    out = []
    for (row, *_), own in zip(rows, found):
        spans = []
        for start, _, stop, kind, value in own:
            n = len(owners[value])
            verdict = "example" if n >= copied else "live" if n == 1 else "shared"
            if kind != "owned" or verdict == "live" or (value in named and verdict != "example"):
                spans.append((kind, start, stop, verdict, counts[value], len(pairs[value]), n))
        out.append((row, spans))
    return out


def told(found):
    return sorted(repr((r.row_index, [tuple(s) for s in r.spans])) for r in found)


def made(n, seed=5):
    draw = random.Random(seed)
    values = ["aB3" + "".join(draw.choice("abcDEF0123456789xYz") for _ in range(22)) for _ in range(12)]
    values += ["%040x" % draw.getrandbits(160) for _ in range(6)] + ["AKIA" + "Z9" * 9, "AKIAAKIA12", "hunter2", "ab=cd"]
    parts = ["token", "TOKEN = \"", "api_key:", "ApiKey='", "secret", "é漢😀 ", "\n", " ", "password==", "passwd : ", "ſecret=abcdefg", "toKen:"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(values if draw.random() < 0.4 else parts) for _ in range(draw.randrange(9)))
        owner = draw.choice(["acme", "acme", "birch", "cedar", None])
        rows.append((i, text, f"{owner}-{draw.randrange(3)}" if draw.random() < 0.9 else None, owner))
    return rows


@pytest.mark.parametrize("hot", [secrets.HOT, 5])
def test_equal_to_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(secrets, "HOT", hot)
    rows = made(400) + [(1, None, "s", "acme"), (1, "", "s", "acme"), (None, "password: hunter22", None, None)] * 2
    example = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
    rows += [(1000 + i, f"token = {example}", f"s{i}", f"owner{i % 7}") for i in range(40)]
    rows += [(2000 + i, f"é {example} é", "s", "acme") for i in range(3)]
    rows += [(3000, "k " + "token = abcdefghijk " * 8_000, "s", "acme"), (3001, "deadbeef" * 40_000, "s", "acme")]
    rows += [(3002, " " * 200_000 + "token" + " " * 200_000, "s", "acme")]
    schema = "row_index long, note string, data_source_id string, organization_id string"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as value", "'x' as hits", "1 as row_key", "'x' as cell")
    found = secrets.secret_cells(frame.repartition(5), "note").collect()
    assert told(found) == sorted(repr(r) for r in slow(rows))
    verdicts = {r.row_index: [s.verdict for s in r.spans] for r in found}
    assert set(verdicts[1000]) == {"example"} and verdicts[2000] == []
    assert secrets.secret_cells(frame.limit(0), "note").count() == 0


def test_bare_copy_of_an_announced_value(spark):
    value = "Zx8Kq2LmN4pR7sT1vW3y"
    rows = [
        (1, f"password: {value}", "s1", "acme"), (2, f"see {value} there", "s2", "birch"),
        (3, "see Zx8Kq2LmN4pR7sT1vW9z", "s1", "acme"), (4, "see Qx8Kq2LmN4pR7sT1vW9z", "s1", "acme"),
        (5, "see Qx8Kq2LmN4pR7sT1vW9z", "s2", "birch"), (6, "abcdefghijklmnopqrstuvw ABCDEFGHIJKLMNOPQRSTU1", "s", "a"),
    ]
    frame = spark.createDataFrame(rows, "row_index long, note string, data_source_id string, organization_id string")
    found = {r.row_index: [(s.kind, s.verdict) for s in r.spans] for r in secrets.secret_cells(frame, "note").collect()}
    assert found == {
        1: [("assign", "shared")], 2: [("owned", "shared")], 3: [("owned", "live")], 4: [], 5: [], 6: [],
    }


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(made(5), "row_index long, note string, data_source_id string, organization_id string")
    plan = secrets.secret_cells(frame, "note")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
