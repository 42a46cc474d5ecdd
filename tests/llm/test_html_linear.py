"""The page parser on hostile pages."""

from __future__ import annotations

import time

import pytest

from quillframe.llm import html

UNITS = [
    "<head>", "</x><div>", "<p ", "<p", "<div>", "<body>", "<script ", "</script ", "<!--", "<!", "<button>", "<li>", "<p \"", "<p '", "<a>", "<tr><td>",
    "<title>", "<svg/>", "</div>", "<p class=", "<p>&amp", "<head></head ",
]


@pytest.mark.parametrize("unit", UNITS)
def test_parse(unit):
    n = 2_000_000 // len(unit)
    start = time.perf_counter()
    html.parse(unit * n)
    html.parse(unit * n + ">")
    assert time.perf_counter() - start < 40


@pytest.mark.parametrize("before,unit", [("<button>" * 30_000, "<p></p>"), ("<ul>" + "<div>" * 30_000, "<li></li>"), ("<table>" + "<div>" * 30_000, "<tr></tr>"), ("<div>" * 30_000, "</section>")])
def test_deep(before, unit):
    start = time.perf_counter()
    html.parse(before + unit * 30_000)
    assert time.perf_counter() - start < 5


def test_comments_and_soup():
    text = lambda s: [t for n in html.parse(s).nodes for t, _ in n.own]
    assert text("<p>a<!-- > -->b<p>c<!-- d") == ["ab", "c"]
    assert text("<p>a<!-- <p>b") == ["a"] and text("x < y > z") == ["x < y > z"] and text("<p a='>'>b") == ["b"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
