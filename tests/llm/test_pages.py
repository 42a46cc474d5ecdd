"""Extraction against pages labelled by hand."""

from __future__ import annotations

import pytest

from quillframe.llm import html

P1 = "The council met on Tuesday evening to discuss the new bridge over the river, and more than two hundred residents came to listen."
P2 = "After three hours of debate the members voted in favour of the plan, though several asked for a review of the costs next spring."
P3 = "Work on the foundations should begin in the autumn, the engineer said, if the weather allows and the permits are granted in time."

PAGES = {
    "blog with a sidebar": (
        f"<html><head><title>x</title><style>p{{color:red}}</style></head><body><header class=site-header><a href=/>My site</a></header>"
        f"<nav class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul></nav>"
        f"<main><article class=post><h1>A new bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article></main>"
        f"<aside class=sidebar><h3>Related posts</h3><ul><li><a href=/1>Other story one</a></li><li><a href=/2>Other story two</a></li></ul></aside>"
        f"<footer class=footer><p>Copyright &copy; 2024 My site. All rights reserved.</p></footer></body></html>",
        ["A new bridge", P1, P2, P3],
    ),
    "comments and a notice": (
        f"<body><div class=cookie-banner><p>We use cookies to improve your visit.</p><button>Accept</button></div>"
        f"<div id=content><h2>A new bridge</h2><p>{P1}</p><div class='ad-slot'><p>Buy cheap shoes today.</p></div><p>{P2}</p></div>"
        f"<div id=comments><h3>2 comments</h3><div class=comment><p>I think that this is a wonderful idea for our town and its people.</p></div></div>"
        f"<form class=newsletter><label>Your mail</label><input name=m><button>Subscribe</button></form></body>",
        ["A new bridge", P1, P2],
    ),
    "lists and entities": (
        f"<body><ul class=nav><li><a href=/>Start</a></ul><article><h1>Caf&eacute; &amp; bar</h1><p>{P1}\n   <em>And</em> more&nbsp;of it.</p>"
        f"<blockquote>{P3}</blockquote><p>{P2}</p><script>var p = '<p>not text</p>';</script></article><div class=share-buttons><a href=#>Share</a> <a href=#>Tweet</a></div></body>",
        ["Café & bar", f"{P1} And more of it.", P3, P2],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    assert html.main_text(source, html.trained()).split("\n\n") == want
