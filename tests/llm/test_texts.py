"""PII, chats and HTML against the stated patterns, exact round trips and hand-made pages."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyledger.llm import chat, disclosure
from tidyledger.llm.disclosure import disclosing_cells, entities, sanitised
from tidyledger.llm.html_text import extracted_cells, main_text

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_entities(text):
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    ]
    return [(kind, start, stop) for start, _, stop, kind in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.text("a@.-+0123456789 ()é_%\n", max_size=60))
def test_entities_are_the_patterns(text):
    assert entities(text) == slow_entities(text)


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e f@@g.h", "1.2.3.4.5.6.7.8", "300.1.1.1 010.001.1.255", "4111 1111-1111 1111", "+1 (212) 555-0199.",
     "x@y 1.2.3.4@e.f", "é1.2.3.4é a.b@c-d.e-f.", "4111111111111111@x.y +4111111111111111"],
)
def test_entities_of_odd_texts(text):
    assert entities(text) == slow_entities(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1(" * 100_000, "+" + "1 (" * 100_000):
        entities(text)


def cells(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "row_index long, note string, spans string, near int")


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"filler words go here and there while passport 4{i:03d}11@mail{i}.example closes the line") for i in range(12)]
    rows += [(100 + i, "filler words go here and there and closes the line of text") for i in range(60)]
    rows += [(900, None), (901, ""), (902, "a@b.cd"), (902, "a@b.cd"), (None, "x +1 212 555 0199 y")]
    found = {}
    for r in disclosing_cells(cells(spark, rows), "note").collect():
        found.setdefault(r.row_index, []).append([(s.kind, s.start, s.stop) for s in r.spans])
    text = rows[3][1]
    at = text.index("passport")
    assert ("term", at, at + 8) in found[3][0]
    assert [s for s in found[3][0] if s[0] != "term"] == slow_entities(text)
    assert not any(text[a:b] in ("closes", "the", "line") for kind, a, b in found[3][0] if kind == "term")
    assert found[100] == [[]] and found[900] == [[]] and found[901] == [[]]
    assert found[902] == [[("email", 0, 6)]] * 2 and found[None] == [slow_entities(rows[-1][1])]
    assert disclosing_cells(cells(spark, []), "note").count() == 0


def test_copies_of_one_text_reveal_nothing(spark):
    rows = [(i, "unique neighbour words a@b.cd around it") for i in range(50)]
    kinds = {s.kind for r in disclosing_cells(cells(spark, rows), "note").collect() for s in r.spans}
    assert kinds == {"email"}


def told(spark, rows, **parameters):
    found = disclosing_cells(cells(spark, rows), "note", **parameters).collect()
    texts = dict(rows)
    return {r.row_index: sorted({texts[r.row_index][s.start : s.stop] for s in r.spans if s.kind == "term"}) for r in found}


def test_the_name_beside_one_address_is_found_everywhere(spark):
    """A term met with one entity alone, in texts that differ, and in a text that names the person only."""
    fill = ["red", "green", "blue", "grey", "white", "black", "pink"]
    rows = [(i, f"{fill[i % 7]} note {i} of Zebulon for z.k@mail.example {fill[i % 5]} and the {fill[i % 3]} rest {i}") for i in range(60)]
    rows += [(100, "Yesterday zebulon came home")] + [(200 + i, f"note {i} of the {fill[i % 7]} day for and of the rest") for i in range(300)]
    found = told(spark, rows)
    assert all(found[i] == ["Zebulon"] for i in range(60)) and found[100] == ["zebulon"]
    assert all(found[200 + i] == [] for i in range(300))
    none = told(spark, [(i, rows[0][1]) for i in range(60)])
    assert set(map(tuple, none.values())) == {()}


def test_mutual_information_by_brute_force(spark):
    import math
    import random
    from collections import Counter

    draw = random.Random(8)
    people = [f"p{n}@mail.example" for n in range(6)]
    rows = [
        (i, " ".join([draw.choice("abcdefgh") + str(n % 3) for n in range(9)] + [f"name{who}" if draw.random() < 0.8 else "someone", people[who]]))
        for i in range(150)
        for who in [draw.randrange(6)]
    ]
    rows += [(500 + i, f"here name{i % 6} stands alone {i}") for i in range(30)]
    counts = Counter(w.lower() for _, t in rows for w in disclosure.WORD.findall(t))
    total, both, of = sum(counts.values()), Counter(), Counter()
    for text in {t for _, t in rows}:
        met = {(e, term) for _, e, term, _, _ in disclosure.company(text, disclosure.entities(text))}
        both.update(met)
        of.update({e for e, _ in met})
    share = {
        (e, t): math.log(n * total / (max(counts[t], n) * of[e])) / math.log(total / of[e]) for (e, t), n in both.items() if n >= 3
    }
    wanted = {t for (_, t), s in share.items() if s >= 0.7}
    assert wanted and wanted != {t for _, t in both}
    found = told(spark, rows, disclosure=0.7, support=3)
    kinds = {w for terms in found.values() for w in terms}
    assert wanted <= kinds
    assert all(set(found[500 + i]) == ({f"name{i % 6}"} & wanted) for i in range(30))


def test_sanitised(spark):
    rows = spark.createDataFrame([("to a@b.cd now",), (None,)], "note string")
    span = "array<struct<kind string, start int, stop int>>"
    spans = F.expr(f"CAST(array(struct('email', 3, 9), struct('ip', 5, 12)) AS {span})")
    made = rows.select(sanitised(F.col("note"), F.when(F.col("note").isNotNull(), spans)).alias("c")).collect()
    assert [r.c for r in made] == ["to [email]w", ""]


TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 3, "user", None),
    (2, 5, "user", "a <b> & &lt; </turn>\n<next>"), (2, 1, "system", "\\### Assistant: </turn> ok"), (2, 7, "assistant", ""),
    (3, 0, "tool<x>&", "<turn user>"), (None, 0, "assistant", "lost"), (4, 0, None, "é\n🙂"), (4, None, "user", "first"),
    (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "assistant", "&amp;" * 3),
]


def test_chats_round_trip(spark):
    schema = "chat_id long, turn long, role string, text string, turns string, formatted int"
    frame = spark.createDataFrame([(*t, "clash", 1) for t in TURNS], schema).repartition(4)
    made = chat.formatted_chats(frame).withColumn("read", chat.read_turns("formatted"))
    found = {r.chat_id: r for r in made.withColumn("learned", chat.read_trained("formatted", "loss_mask")).collect()}
    chats = {}
    for key, turn, role, text in TURNS:
        chats.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(chats)
    for key, turns in chats.items():
        turns.sort()
        assert [(t.role, t.text) for t in found[key].read] == [t[2:] for t in turns]
        assert found[key].learned == "".join(t[3] for t in turns if t[2] == "assistant")
    assert found[1].formatted == (
        "<turn user>hello</turn>\n<turn assistant>one<next>two</turn>\n<turn user></turn>\n"
    )
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.formatted_chats(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h2>Site</h2><p>Welcome, friends, to the site</p></header><nav><a href=x>Home</a><a href=y>About</a></nav>
<div class="cookie-notice"><p>We use cookies, as all do, to know you.</p></div>
<div id="content"><h1>Head &amp; line</h1><p>First   paragraph, with a <a href=z>link</a>,<br>and more.
<p>Second, <b>left open<p>Third.</b></p><ul class=menu><li>x</li></ul><blockquote>Quoted&nbsp;words, here</blockquote>
<form><p>Your name, please</p></form><script>var t="</p><p>no</p>";</script>
<section class="comments"><p>I think, therefore, I comment.</p></section></div>
<div class="sidebar"><p>Read this, too, and that</p></div><!-- <p>hidden</p> --><footer>&copy; all, rights</footer></body></html>"""


def test_article_of_a_page():
    assert main_text(PAGE).split("\n\n") == [
        "Head & line", "First paragraph, with a link, and more.", "Second, left open", "Third.", "Quoted words, here",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("just text", "just text"), ("<p>1 < 2 &amp; 3", "1 < 2 & 3"), ("<p", ""), ("<!-- open", ""),
     ("<script>x", ""), ('<p title="a>b">c</p>', "c"), ("<p title='open>c</p>", "c"), ("<p>a</b></i>b</p>", "ab"),
     ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<div style='display: none'>x</div><p>y</p>", "y")],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_pages_and_tables_of_pages(spark):
    long = "<article>" + "<p>word, word &lt;</p>" * 30_000 + "</article>"
    assert main_text(long).count("word, word <") == 30_000
    assert main_text("<div>" * 30_000 + "deep") == "deep" and main_text("<" * 50_000)
    rows = spark.createDataFrame([(1, PAGE), (2, None), (2, None), (None, "<p>é</p>")], "row_index long, page string")
    found = sorted((r.row_index or 0, r.text, r.n_chars) for r in extracted_cells(rows, "page").collect())
    assert found[0] == (0, "é", 1) and found[2:] == [(2, "", 0)] * 2 and found[1][2] == len(found[1][1])
    assert extracted_cells(rows.limit(0), "page").count() == 0
