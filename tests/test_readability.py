"""Main texts of hand-made pages."""

import pytest

from tidemill.functions import pages

A = "The river rose by two metres overnight, and the town's lower streets were closed, officials said on Monday morning."
B = "Volunteers carried sandbags to the old mill, while the fire brigade pumped water from cellars, schools and shops nearby."
C = "Forecasters expect the rain to end by Wednesday, though the dam will release water until the weekend, they warned."
LINKS = "".join(f'<li><a href="/{i}">Another headline about something else entirely, number {i}, with commas</a></li>' for i in range(12))
TALK = "<p>I live there, and I can tell you, it was far worse than the paper says, believe me, far worse than that.</p>" * 2
P = "".join(f"<p>{x}</p>" for x in (A, B, C))
BODY = [A, B, C]

PAGES = {
    "unmarked div": (f"<html><body><div><ul>{LINKS}</ul></div><div>{P}</div></body></html>", BODY),
    "link list longer than the text": (f"<body><div><ul>{LINKS * 5}</ul></div><div>{P}</div></body>", BODY),
    "menu of paragraphs": (f"<body><div>{''.join(f'<p><a href=/>{A} {i}</a></p>' for i in range(9))}</div><div>{P}</div></body>", BODY),
    "comments": (f"<body><div class=story>{P}</div><div class=comments>{TALK * 4}</div></body>", BODY),
    "sidebar by id": (f'<body><div id="left-sidebar">{TALK * 4}</div><div>{P}</div></body>', BODY),
    "nested blocks": (f"<body><div><div><section>{P}</section></div></div><div>Short note.</div></body>", BODY),
    "sibling with text": (f"<body><div><div>{P}</div><div><p>{A} {B}</p><p>{C} {A}</p></div></div></body>", [*BODY, f"{A} {B}", f"{C} {A}"]),
    "long paragraph beside": (f"<body><div><div>{P}{P}</div><p>{B} {C}</p><p><a href=/>{B} {C}</a></p></div></body>", [*BODY, *BODY, f"{B} {C}"]),
    "short lines go": (f"<body><div>{P}<p>Photo: agency</p></div></body>", BODY),
    "notices go": (f"<body><div>{P}<p>版权 {A}</p></div></body>", BODY),
    "forms and scripts": (f"<body><form>{TALK * 3}</form><script>var a = '{A}';</script><div>{P}</div></body>", BODY),
    "cells of a table": (f"<body><table><tr><td>{A}</td><td>{B}</td><td>{C}</td></tr></table></body>", BODY),
    "below 200 characters, an article": (f"<body><div>{TALK[:70]}</div><article><p>{A}</p></article></body>", [A]),
    "below 200 characters, a content div": (f"<body><div><p>x</p></div><div class=content><p>{B}</p></div></body>", [B]),
    "nothing": ("<body></body>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, expected = PAGES[name]
    assert " ".join(pages.main_part(html).split()) == " ".join(expected)


def test_link_density():
    root = pages.parse("<div>abcd<a href=/>efgh</a></div>")
    assert pages.link_density(root) == 0.5 and pages.link_density(pages.parse("")) == 0


def test_null_and_broken_pages():
    assert pages.main_part(None) == "" == pages.main_part("")
    assert A in pages.main_part(f"<div><p>{A}<p>{B}<div></p>{C}")
