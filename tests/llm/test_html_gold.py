"""Blocks of hand-made pages against what a reader would call the article: each block with its verdict."""

import pytest

from tidyledger.llm.html_text import main_text

ONE = "First paragraph of the article, long enough to be told from a menu, with commas, and with a full stop at its end."
TWO = "Second paragraph of the article, which goes on about the matter, and which says a little more than the first did."
LINKS = "".join(f"<li><a href=/{n}>Entry number {n}</a></li>" for n in range(5))
ENTRIES = [f"Entry number {n}" for n in range(5)]
BODY = f"<h1>Title</h1><p>{ONE}</p><p>{TWO}</p>"
TEXT = ["Title", ONE, TWO]
MENU = f"<nav><ul>{LINKS}</ul></nav>"
COMMENTS = "<div class=comments><p>I like this, a lot, and say so.</p><p>So do I, and I say it too, at length.</p></div>"

# name -> (page, article blocks, blocks that are no part of it)
GOLD = {
    "references in an article": (
        f"<body>{MENU}<article>{BODY}<h2>References</h2><ul>{LINKS}</ul></article></body>", [*TEXT, "References", *ENTRIES], [],
    ),
    "references in a div": (
        f"<body><div><p>{ONE}</p><p>{TWO}</p><h2>References</h2><ol>{LINKS}</ol></div></body>", [ONE, TWO, "References", *ENTRIES], [],
    ),
    "table of links in an article": (
        "<body><article>" + BODY + "<table>" + "".join(f"<tr><td><a href=x>Cell {n}</a></td></tr>" for n in range(4))
        + "</table></article></body>", [*TEXT, *(f"Cell {n}" for n in range(4))], [],
    ),
    "short sentence with a link": (
        f"<body><div class=text><p>{ONE}</p><p>{TWO}</p></div><p>See the <a href=x>manual</a>.</p></body>",
        [ONE, TWO, "See the manual."], [],
    ),
    "row of links beside the text": (
        f"<body><div class=text><p>{ONE}</p><p>{TWO}</p></div><p><a href=a>Home</a> | <a href=b>About us</a></p></body>",
        [ONE, TWO], ["Home | About us"],
    ),
    "page in one form": (
        f"<body><form action=x><input name=s>{MENU}<div id=c>{BODY}</div><footer>Legal</footer></form></body>", TEXT, ["Legal", *ENTRIES],
    ),
    "page in one form with an article": (f"<form>{MENU}<article><p>Short.</p></article></form>", ["Short."], ENTRIES),
    "form in the article": (
        f"<article>{BODY}<form><p>Leave your address here, and we will write to you, often, and at great length, promised.</p>"
        "<label>Mail</label></form></article>", TEXT, ["Mail"],
    ),
    "form alone": ("<body><form><p>Name</p><label>Mail</label></form></body>", [], ["Name", "Mail"]),
    "menu without a name": (f"<body><div><ul>{LINKS}</ul><p>{ONE}</p><p>{TWO}</p></div></body>", [ONE, TWO], ENTRIES),
    "comments and sidebar": (
        f"<body>{MENU}<main>{BODY}</main>{COMMENTS}<aside><p>Ad, buy this</p></aside></body>", TEXT,
        ["I like this, a lot, and say so.", "Ad, buy this", *ENTRIES],
    ),
    "list of links under a heading outside": (
        f"<body><article>{BODY}</article><div><h3>Elsewhere</h3><ul>{LINKS}</ul></div></body>", TEXT, ENTRIES,
    ),
    "pre, quote and table of data": (
        f"<article>{BODY}<pre>x = 1</pre><blockquote>Said so.</blockquote><table><tr><td>1</td><td>2</td></tr></table></article>",
        [*TEXT, "x = 1", "Said so.", "1", "2"], [],
    ),
}


@pytest.mark.parametrize("name", GOLD)
def test_blocks(name):
    page, wanted, unwanted = GOLD[name]
    found = [b for b in main_text(page).split("\n\n") if b]
    assert found == wanted
    assert not set(found) & set(unwanted)


def test_recall_and_precision_by_block():
    right = found = wanted = 0
    for page, blocks, _ in GOLD.values():
        own = [b for b in main_text(page).split("\n\n") if b]
        right, found, wanted = right + len(set(own) & set(blocks)), found + len(own), wanted + len(blocks)
    assert right / wanted == 1 and right / found == 1
