"""Containers of the text whose names look like those of a page's furniture, and long attribute values."""

import time

import pytest

from tidyledger.llm.html_text import main_text

TEXT = ["First paragraph, of some length, with commas, and words.", "Second one, a little longer, of the same kind, too."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
SIDE = '<div class="sidebar"><p>Read this, too</p></div><nav><a href=x>Home</a></nav>'


@pytest.mark.parametrize("names", ["class='content with-sidebar'", "class=has-comments", "id='search'", "role=dialog"])
def test_named_wrappers_keep_the_text(names):
    for inner in (BODY, f"<div>{BODY}</div>", f"<section>{BODY}</section>{SIDE}"):
        assert main_text(f"<body><div {names}>{inner}</div>{SIDE}</body>").split("\n\n") == TEXT
    assert main_text(f"<div {names}><div class=has-alerts>{BODY}</div></div>{SIDE}").split("\n\n") == TEXT


def test_longer_comments_do_not_replace_the_article():
    one = "<p>I think, therefore, I comment, at length, as all do, and on, and on.</p>"
    for comments in (one * 4, f"<div class=comment>{one}</div>" * 40):
        for around in ("", "class='with-sidebar'"):
            page = f"<div {around}><div id=a>{BODY * 2}</div><div class=comments>{comments}</div></div>"
            assert main_text(page).split("\n\n") == TEXT * 2


def test_names_do_not_count_where_nothing_else_is_left():
    assert main_text("<div class=menu>one</div><div class=banner>two</div>") == "one\n\ntwo"
    assert main_text("<div class=menu hidden>one</div>") == ""


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attribute_values(quote):
    value = "<p>not, this</p> > " * 20_000
    assert main_text(f"<div data-json={quote}{value}{quote}>{BODY}</div>").split("\n\n") == TEXT


@pytest.mark.parametrize("part", ["<p '>' ", "<p '>\" ", "<p \"' ", "<p a='>", "<p a='>x</p>\" "])
def test_odd_quotes_take_linear_time(part):
    start = time.process_time()
    main_text(part * 60_001)
    assert time.process_time() - start < 20
