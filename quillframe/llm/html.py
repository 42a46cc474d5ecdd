"""Operator 10: main text of web pages.

Method.  A page's block elements form a tree.  Each has a hidden label, content or not, with a potential of its own
(tag, names in class, id and role, amount of text, share of link text) and one shared with its parent.  Sum-product
messages, up the tree and down again, give every element's marginal; the text of elements that are more likely content
than not is the result.  The potentials are fitted by maximum likelihood on labelled pages, which ``labelled_pages``
writes in many layouts from random syllables, so that nothing depends on a language or on the pages to be read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches, struct, table

# --- The tree -------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr picture source video audio track map area embed object param".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
OPAQUE = frozenset("script style noscript template textarea select iframe svg title math canvas head".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_NO_P_CLOSE = frozenset("button label input option".split())

TAGS = (
    "p h1 h2 h3 h4 h5 h6 li ul ol div section article main nav header footer aside form table tr td th blockquote pre"
    " figure figcaption body html button label input option dl dt dd details dialog address fieldset menu"
).split()
#: Groups of name parts; a node has a group's feature if its class, id or role holds one of them.
NAMES = {
    "menu": r"nav|menu|breadcrumb|crumb|tabs|toc|pager|pagination|skip",
    "advert": r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|adslot|banner|promo|sponsor|dfp|outbrain|taboola",
    "comments": r"comment|respond|reply|replies|discuss|disqus|feedback|review",
    "side": r"side|widget|related|recommend|share|social|tags?\b|popular|trending|more-|teaser|rail",
    "foot": r"foot|copyright|legal|colophon|imprint|contentinfo",
    "head": r"header|masthead|logo|topbar|site-?title|brand",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|toast|warning",
    "form": r"form|search|login|register|input",
    "content": r"content|article|post|entry|story|main|body|text|prose|page|blog",
}
_NAMES = {k: re.compile(v, re.I) for k, v in NAMES.items()}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    hidden: bool = False
    own: list[tuple[str, int]] = field(default_factory=list)  # text and characters of it that are links


@dataclass
class Page:
    nodes: list[Node]
    order: list[tuple[int, int]]  # (node, index in own) in page order


def _squeezed(parts: list[str]) -> str:
    raw = "".join(parts)
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


class Stack:
    """Open elements, with the places of each tag among them, so that no question walks the whole stack."""

    def __init__(self) -> None:
        self.nodes: list[int] = [0]
        self.tags: list[str] = ["html"]
        self.solid: list[int] = [0]  # the highest place up to here whose tag ends a search for an open paragraph
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.solid.append(self.solid[-1] if tag in _NO_P_CLOSE else at)
        self.places.setdefault(tag, []).append(at)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.tags.pop()].pop()
            self.nodes.pop()
            self.solid.pop()

    def last(self, tags: Iterable[str]) -> int:
        """The highest place of one of the tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


class _Ahead:
    """Searches that remember what isn't ahead, so that a page is gone through but once for each pattern."""

    def __init__(self, source: str):
        # No tag ends beyond the last bracket; patterns needn't look for its end there.
        self.source, self.limit = source, source.rfind(">") + 1
        self.missing: set[str] = set()

    def find(self, name: str, pattern: str, at: int) -> re.Match | None:
        if name in self.missing:
            return None
        m = _compiled(pattern).search(self.source, at, self.limit)
        if m is None:
            self.missing.add(name)
        return m


@lru_cache(maxsize=100)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def parse(source: str) -> Page:
    """The tree of block elements of a page; tag soup gives a tree as well, in time linear in its length."""
    nodes, order, stack = [Node("html", -1)], [], Stack()
    parts: list[str] = []
    links, link_from, size, at = 0, 0, 0, 0
    in_link = has_body = False
    ahead = _Ahead(source)

    def flush() -> None:
        nonlocal parts, links, size, link_from
        if in_link:
            links += size - link_from
        if parts and (text := _squeezed(parts)):
            node = stack.nodes[-1]
            nodes[node].own.append((text, min(links, len(text))))
            order.append((node, len(nodes[node].own) - 1))
        parts, links, size, link_from = [], 0, 0, 0

    end = len(source)
    while at < end:
        m = _TAG.search(source, at, ahead.limit) if at < ahead.limit else None
        if m is None:
            # An unclosed comment beyond the last tag hides the rest.
            hidden = source.find("<!--", max(at, ahead.limit))
            parts.append(source[at : hidden if hidden >= 0 else end])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
            size += m.start() - at
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                close = source.find("-->", at)
                at = close + 3 if close >= 0 else end
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                if in_link:
                    links += size - link_from
                in_link = False
            elif tag not in INLINE and tag not in VOID and (open_at := stack.last((tag,))):
                flush()
                stack.cut(open_at)
            continue
        if tag in OPAQUE:
            if not m[3].endswith("/") or tag in ("script", "style", "textarea", "title"):
                close = ahead.find(tag, rf"</{tag}\b[^>]*>", at)
                if tag == "head" and close is None:
                    close = ahead.find("<body", r"(?=<body\b)", at)
                at = close.end() if close else (at if tag == "head" else end)
            continue
        if tag == "a":
            in_link, link_from = True, size
            continue
        if tag == "br":
            parts.append(" ")
            size += 1
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID and tag != "input":
            continue
        attrs = m[3]
        if tag == "html" or tag == "body" and has_body:
            continue
        has_body |= tag == "body"
        if tag not in _NO_P_CLOSE:
            k = stack.solid[-1]
            inside = stack.tags[k]
            if k and (inside == "p" or inside[0] == "h" and inside[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit()):
                stack.cut(k)
        if tag in _CLOSES:
            shut, stop = _CLOSES[tag]
            while (k := stack.last(shut)) > stack.last(stop):
                stack.cut(k)
                if tag != "tr":
                    break
        node = Node(tag, stack.nodes[-1])
        if attrs:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            node.names = " ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop")).strip()
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
        nodes.append(node)
        if tag != "input":
            stack.push(len(nodes) - 1, tag)
    flush()
    return Page(nodes, order)


# --- Features -------------------------------------------------------------------------------------------------------

_TEXTUAL = (
    "bias text_1 text_10 text_40 text_120 text_400 links_half links_most sentence sub_400 sub_2000 sub_links"
    " hidden leaf copyright single custom sub_share share_none"
).split()
FEATURES = [*(f"tag:{t}" for t in TAGS), *(f"name:{n}" for n in NAMES), *_TEXTUAL]
_INDEX = {name: i for i, name in enumerate(FEATURES)}
_STEPS = [(_INDEX[f"text_{n}"], n) for n in (1, 10, 40, 120, 400)]


@lru_cache(maxsize=20_000)
def _name_features(names: str) -> tuple[int, ...]:
    return tuple(_INDEX[f"name:{k}"] for k, r in _NAMES.items() if r.search(names))


def features(page: Page) -> list[list[int]]:
    """The indices of the features that each node has."""
    n = len(page.nodes)
    size, links, kids = [0] * n, [0] * n, [0] * n
    own = [0] * n
    for i, node in enumerate(page.nodes):
        own[i] = sum(len(t) for t, _ in node.own)
        size[i], links[i] = own[i], sum(x for _, x in node.own)
    own_links = links[:]
    for i in range(n - 1, 0, -1):
        p = page.nodes[i].parent
        size[p] += size[i]
        links[p] += links[i]
        kids[p] += 1
    out = []
    total = max(1, size[0])
    for i, node in enumerate(page.nodes):
        f = [_INDEX["bias"], _INDEX.get(f"tag:{node.tag}", _INDEX["custom"])]
        if node.names:
            f += _name_features(node.names)
        f += [k for k, least in _STEPS if own[i] >= least]
        if own[i]:
            if own_links[i] * 2 > own[i]:
                f.append(_INDEX["links_half"])
            if own_links[i] * 10 > own[i] * 9:
                f.append(_INDEX["links_most"])
            text = node.own[0][0]
            if text[-1] in ".!?:;…\"”»。" and " " in text:
                f.append(_INDEX["sentence"])
            if "©" in text or "(c)" in text.lower():
                f.append(_INDEX["copyright"])
            if " " not in text:
                f.append(_INDEX["single"])
        if size[i] >= 400:
            f.append(_INDEX["sub_400"])
        if size[i] >= 2000:
            f.append(_INDEX["sub_2000"])
        if size[i] * 2 > total:
            f.append(_INDEX["sub_share"])
        if not size[i]:
            f.append(_INDEX["share_none"])
        if links[i] * 2 > size[i] > 0:
            f.append(_INDEX["sub_links"])
        if node.hidden:
            f.append(_INDEX["hidden"])
        if not kids[i]:
            f.append(_INDEX["leaf"])
        out.append(f)
    return out


#: Kinds of edges, each with its own 2 x 2 potential: by the child's tag, and whether the parent is a whole-page element.
_LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption".split())
_TOP_TAGS = frozenset(("html", "body"))
EDGE_KINDS = 4


def edge_kinds(page: Page) -> list[int]:
    nodes = page.nodes
    return [(nodes[i].tag in _LEAF_TAGS) + 2 * (nodes[nodes[i].parent].tag in _TOP_TAGS) if i else 0 for i in range(len(nodes))]


# --- The model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    unary: np.ndarray  # log-odds of content by feature
    edges: np.ndarray  # EDGE_KINDS x 2 x 2, by parent's and child's label


def marginals(odds: list[float], parents: list[int], kinds: list[int], edges: list) -> tuple[list[float], list[tuple[float, ...]]]:
    """Sum-product on the tree: each node's probability of being content, and each edge's joint probabilities.

    Nodes come after their parents.  Messages are normalised, so deep and large trees don't overflow.
    """
    n = len(odds)
    up0, up1 = [1.0] * n, [1.0] * n  # belief from the node itself and below
    to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
    for i in range(n):
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds[i]))))
        up0[i], up1[i] = 1 - p, p
    for i in range(n - 1, 0, -1):
        (a, b), (c, d) = edges[kinds[i]]
        s = up0[i] + up1[i]
        x, y = up0[i] / s, up1[i] / s
        up0[i], up1[i] = x, y
        m0, m1 = x * a + y * b, x * c + y * d
        s = m0 + m1
        to0[i], to1[i] = m0 / s, m1 / s
        q = parents[i]
        u0, u1 = up0[q] * to0[i], up1[q] * to1[i]
        s = u0 + u1
        up0[q], up1[q] = u0 / s, u1 / s
    out = [0.0] * n
    joint: list[tuple[float, ...]] = [(0.0,) * 4] * n
    out[0] = up1[0] / (up0[0] + up1[0])
    for i in range(1, n):
        q = parents[i]
        # The parent's belief without this child's message.
        r0, r1 = (1 - out[q]) / max(to0[i], 1e-300), out[q] / max(to1[i], 1e-300)
        (a, b), (c, d) = edges[kinds[i]]
        j = (r0 * a * up0[i], r0 * b * up1[i], r1 * c * up0[i], r1 * d * up1[i])
        s = sum(j) or 1.0
        joint[i] = tuple(v / s for v in j)
        out[i] = joint[i][1] + joint[i][3]
    return out, joint


def infer(page: Page, model: Model) -> list[float]:
    odds = [float(model.unary[f].sum()) for f in features(page)]
    edges = np.exp(model.edges).tolist()
    return marginals(odds, [x.parent for x in page.nodes], edge_kinds(page), edges)[0]


def main_text(source: str | None, model: Model) -> str:
    """Blocks of content in page order, joined by two line feeds; empty for null and for pages without content."""
    if not source:
        return ""
    page = parse(source)
    p = infer(page, model)
    return "\n\n".join(page.nodes[i].own[k][0] for i, k in page.order if p[i] > 0.5)


def fit(pages: list[tuple[str, set[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 2e-3) -> Model:
    """Maximum likelihood by gradient ascent (Adam).  pages: a source and the texts of its content blocks."""
    data = []
    for source, content in pages:
        page = parse(source)
        good, size = [0] * len(page.nodes), [0] * len(page.nodes)
        for i, node in enumerate(page.nodes):
            size[i] = sum(len(t) for t, _ in node.own)
            good[i] = sum(len(t) for t, _ in node.own if t in content)
        own, own_good = size[:], good[:]
        for i in range(len(page.nodes) - 1, 0, -1):
            size[page.nodes[i].parent] += size[i]
            good[page.nodes[i].parent] += good[i]
        label = [int(2 * (own_good[i] if own[i] else good[i]) > (own[i] or size[i])) for i in range(len(page.nodes))]
        data.append((features(page), [x.parent for x in page.nodes], edge_kinds(page), label))
    model = Model(np.zeros(len(FEATURES)), np.zeros((EDGE_KINDS, 2, 2)))
    size = sum(len(d[0]) for d in data)
    flat = np.concatenate([model.unary, model.edges.ravel()])
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        model = Model(flat[: len(FEATURES)], flat[len(FEATURES) :].reshape(EDGE_KINDS, 2, 2))
        g_unary, g_edges = np.zeros(len(FEATURES)), np.zeros((EDGE_KINDS, 2, 2))
        edges = np.exp(model.edges).tolist()
        for feats, parents, kinds, label in data:
            p, joint = marginals([float(model.unary[f].sum()) for f in feats], parents, kinds, edges)
            for i, f in enumerate(feats):
                g_unary[f] += label[i] - p[i]
                if i:
                    g_edges[kinds[i], label[parents[i]], label[i]] += 1
                    g_edges[kinds[i]] -= np.reshape(joint[i], (2, 2))
        g = np.concatenate([g_unary, g_edges.ravel()]) / size - decay * flat / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (0.5 if step > rounds // 2 else 1) * 0.5
    return Model(flat[: len(FEATURES)], flat[len(FEATURES) :].reshape(EDGE_KINDS, 2, 2))


# --- Labelled pages -------------------------------------------------------------------------------------------------


class Writer:
    """Writes one random page and notes the texts of its content blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: set[str] = set()
        self.plain = self.r.random() < 0.25  # a page whose names say nothing

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("bcdfglmnprstvéñö") + r.choice("aeiouá") for _ in range(r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        low, high = (1, 3) if self.r.random() < 0.12 else (low, high)
        return self.words(low, high).capitalize() + self.r.choice("....?!")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, self.r.randint(1, most)])))

    def names(self, *choices: str) -> str:
        r = self.r
        name = self.word() if self.plain or r.random() < 0.1 else r.choice(choices)
        return "" if r.random() < 0.08 else f' {r.choice(["class", "class", "id"])}="{name}"'

    def keep(self, tag: str, text: str) -> str:
        """A content block, with some markup inside."""
        self.content.add(text)
        r, shown = self.r, text
        if r.random() < 0.25 and " " in text:
            a, b = text.split(" ", 1)
            shown = r.choice([f"<b>{a}</b> {b}", f"{a} <em>{b}</em>", f'<a href="/x">{a}</a> {b}', f"{a}<br>{b}", f"<span>{a}</span>\n {b}"])
        close = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        return f"<{tag}>{shown}{close}"

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(n))
        return self.r.choice([f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " ")])

    def box(self, inside: str, tags: str, *names: str) -> str:
        tag = self.r.choice(tags.split())
        return f"<{tag}{self.names(*names)}>{inside}</{tag}>"

    def menu(self) -> str:
        return self.box(self.links(self.r.randint(3, 9)), "nav nav div ul", "nav", "menu", "main-navigation", "breadcrumbs")

    def header(self) -> str:
        inside = self.r.choice(["<div{}>{}</div>", "<p{}>{}</p>", "<h2{}>{}</h2>"]).format(self.names("logo", "site-title"), self.words(1, 4))
        return self.box(inside + (self.menu() if self.r.random() < 0.5 else ""), "header header div", "header", "masthead", "topbar", "site-header")

    def advert(self) -> str:
        inside = self.r.choice([self.prose(2), f"<p>{self.prose(2)}</p>", f'<a href="/buy">{self.words(2, 6)}</a>'])
        return self.box(inside, "div div aside section", "ad", "advert", "ads-top", "sponsored", "promo", "banner")

    def notice(self) -> str:
        inside = f"<p>{self.prose(2)}</p>" + (f"<button>{self.words(1, 2)}</button>" if self.r.random() < 0.6 else "")
        return self.box(self.r.choice([inside, self.prose(2)]), "div div section dialog", "cookie-notice", "consent", "alert", "notice", "popup", "newsletter")

    def form(self) -> str:
        return f"<form{self.names('search', 'signup', 'subscribe')}><label>{self.words(1, 4)}</label><input type='text'><p>{self.sentence()}</p><button>{self.word()}</button></form>"

    def sidebar(self) -> str:
        r = self.r
        blocks = [f"<h3>{self.words(1, 4)}</h3>{self.links(r.randint(3, 8))}"]
        if r.random() < 0.5:
            blocks.append("".join(f'<div{self.names("teaser", "widget")}><h4><a href="/t">{self.words(2, 6)}</a></h4><p>{self.sentence()}</p></div>' for _ in range(r.randint(1, 4))))
        return self.box("".join(blocks), "aside aside div section", "sidebar", "widget", "related", "recommended", "side-rail")

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice(["<li{0}><p>{1}</p></li>", "<div{0}><b>{2}</b><p>{1}</p></div>", "<article{0}><p>{1}</p></article>"]).format(
            self.names("comment", "reply", "comment-body"), self.prose(4), self.word()
        )
        inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))
        tag, name = r.choice(["section", "div", "ol"]), r.choice(["comments", "comment-list", "disqus_thread", "responses", "discussion"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{inside}</{tag}>'

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(2)}", f"<p>{self.prose(2)}</p>", f"<p>&copy; {self.words(2, 6)}</p>{self.links(4)}"])
        return self.box(inside, "footer footer footer div", "footer", "site-footer", "copyright", "legal")

    def article(self) -> str:
        r = self.r
        title = self.keep(r.choice(["h1", "h1", "h2"]), self.words(2, 9))
        out = [f"<header>{title}</header>" if r.random() < 0.15 else title]
        for _ in range(r.choice([1, 2, 3, r.randint(2, 14)])):
            k = r.random()
            if k < 0.74:
                out.append(self.keep("p", self.prose()))
            elif k < 0.80:
                out.append(self.keep(r.choice(["h2", "h3"]), self.words(1, 7)))
            elif k < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.keep("li", r.choice([self.words(1, 5), self.sentence()])) for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif k < 0.89:
                out.append("<blockquote>" + self.keep("p", self.prose(2)) + "</blockquote>")
            elif k < 0.91:
                out.append("<table>" + "".join("<tr>" + self.keep("td", self.words(1, 4)) + self.keep("td", self.words(1, 3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.93:
                out.append("<figure><img src='x.png'>" + self.keep("figcaption", self.sentence()) + "</figure>")
            elif k < 0.95:
                out.append(self.keep("pre", self.words(3, 12)))
            elif k < 0.97:
                out.append(self.advert())
            else:
                out.append(self.box(self.links(3), "div aside", "share", "social", "tags", "related"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        body = self.article()
        body = r.choice(
            [
                f"<article>{body}</article>", f"<article{self.names('post', 'entry', 'article')}>{body}</article>", f"<main>{body}</main>",
                f"<div{self.names('content', 'post-body', 'article-text', 'entry-content', 'story')}>{body}</div>",
                f"<main><article>{body}</article></main>", f"<section{self.names('content', 'main')}>{body}</section>",
            ]
        )
        middle = [body, some(self.comments, 0.35)]
        if r.random() < 0.3:
            middle = [f"<div{self.names('wrapper', 'container', 'page', 'layout')}>{''.join(middle)}{some(self.sidebar, 0.5)}</div>"]
        top = [some(self.notice, 0.25), some(self.header, 0.45), some(self.menu, 0.6), some(self.advert, 0.4), some(self.form, 0.12)]
        low = [some(self.sidebar, 0.35), some(self.advert, 0.2), some(self.form, 0.15), some(self.notice, 0.15), some(self.footer, 0.8)]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{''.join([*top, *middle, *low])}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    out = []
    for i in range(n):
        w = Writer(seed * 1_000_003 + i)
        out.append((w.page(), w.content))
    return out


#: Pages that the model is fitted on.
TRAINING_PAGES = 250


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages(TRAINING_PAGES))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to pages, replacing such columns.

    Pages are read whole.  Null and empty sources, and pages without content, give an empty text.  Tag soup, unclosed
    elements and very deep nesting are read as far as they make sense; equal pages give equal texts; no rows give none.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf(struct("text string, n_chars long"))
    def run(source: pa.Array) -> pa.Array:
        texts = [main_text(s, shared.value) for s in source.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(F.struct(*names).alias("row"), run(F.col(html_column)).alias("new"))
    return out.select(*(F.col(f"row.`{n}`").alias(n) for n in names), "new.text", "new.n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
