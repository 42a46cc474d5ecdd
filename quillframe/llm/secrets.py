"""Operator 4: secrets in texts.

Method.  Besides three base patterns (credential assignments, access keys, long hex runs) texts are lexed as source and
configuration syntax: statements ``name = value`` with ``=``, ``:=``, ``=>``, ``+=``, ``?=`` or ``:`` (declared types,
quoted names and subscripts included), elements and attributes of markup.  Values are lexed as quoted literals with
escapes, in one of several styles, as references or as bare words, and may be joined by ``+``.  Each statement gives
pairs of a target name and literals.

Constants are propagated in the order of the statements: a reference stands for what its name is bound to at that
place, in the innermost scope that binds it (scopes are braces, and bodies of ``def`` and ``class`` by indentation); a
name that isn't bound yet, or only in a scope that has ended, stands for its last binding.  A literal is scored by the
most sensitive target name that it reaches, and by how random its characters are; literals that reach ``MIN_SCORE`` are
spans of kind ``literal``.  Commented code counts as code.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches, struct, table

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: ``[0-9a-f]+`` matches whole runs, so asking for the least length at once finds the same spans faster.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a target name is, by the words that it is made of.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.5, "key": 0.5, "access": 0.3, "api": 0.3,
    "client": 0.2, "signing": 0.4, "encryption": 0.4, "bearer": 0.6, "salt": 0.4,
}
MIN_SCORE, MIN_LITERAL = 1.2, 8
#: Least weight of the name that makes a literal with blanks in it a passphrase.
MIN_PHRASE = 0.9
#: A name without one of these weighs nothing, so a text without any has no literal spans.
_ANY = re.compile("|".join(sorted(SENSITIVE)), re.I)

_OPERATOR = r"[ \t]*+(=>|:=|\?=|\+=|=(?!=)|:(?!:))[ \t]*+"
_STATEMENT = re.compile(
    r"""(?P<open>\{)|(?P<close>\})|(?P<def>^[ \t]*+(?:async[ \t]++)?(?:def|class)[ \t]++\w++[^\n]*:[ \t]*+$)"""
    r"""|<(?P<tag>[A-Za-z_][\w.:-]*+)(?P<attrs>(?:\s++[\w.:-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+)\s*+>(?=[^<\n])"""
    r"""|(?<![\w$.-])[.-]*+(?:(?:var|val|let|const|local|my)[ \t]++\$?(?P<declared>[A-Za-z_]\w*+)(?:[ \t]++[A-Za-z_*\[][\w.*\[\]]*+)?"""
    r"""|(?P<name>[A-Za-z_][\w.-]*+)(?:\[[ \t]*+(?P<q>["'])(?P<item>[^"'\n\]]++)(?P=q)[ \t]*+\])?)"""
    r"""(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.<>\[\]|?]*+(?=[ \t]*=(?!=)))?""" + _OPERATOR +
    r"""|(?P<quote>["'])(?P<key>[^"'\n]++)(?P=quote)\]?""" + _OPERATOR,
    re.M,
)
_VALUE = re.compile(
    r"""[ \t]*+(?:[A-Za-z@]{0,2}(?P<triple>\"{3}|'{3})|[A-Za-z@]{0,2}"(?P<double>(?:[^"\\\n]|\\.)*+)"|[A-Za-z@]{0,2}'(?P<single>(?:[^'\\\n]|\\.)*+)'"""
    r"""|`(?P<raw>[^`]*+)`|\$\{?(?P<ref>[A-Za-z_][\w.]*+)\}?|(?P<bare>[^\s"'`,;(){}\[\]<>]++))"""
)
_ATTRIBUTE = re.compile(r"""([\w.:-]++)\s*+=\s*+(?:"([^"<]*+)"|'([^'<]*+)')""")
_PLUS = re.compile(r"[ \t]*+\+(?!=)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns: leftmost and non-overlapping for each kind, then those that are too short dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """The sum of the weights of the words in a name, at most 1.5."""
    return min(1.5, sum(SENSITIVE.get(w.lower(), 0.0) for w in _WORDS.findall(name)))


def randomness(literal: str) -> float:
    """0 to 1: the entropy of the literal's characters against 4 bits, less for plain words."""
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(map(f, literal)) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, bits / 4) * (1.0 if classes > 1 else 0.5)


def is_secret(literal: str, weight: float, quoted: bool) -> bool:
    """Whether a literal that reaches a name of that weight is a secret."""
    if len(literal) < MIN_LITERAL or (any(map(str.isspace, literal)) and weight < MIN_PHRASE):
        return False
    if not quoted and (literal.islower() or literal.isupper() or literal.istitle()) and literal.isalpha():
        return False
    return weight + randomness(literal) >= MIN_SCORE


class Bindings:
    """Names bound in nested scopes; a value is a set of literal spans and a set of names that it stands for."""

    def __init__(self) -> None:
        self.scopes: list[tuple[int | None, dict]] = [(None, {})]  # indentation of a body, None for braces
        self.last: dict[str, tuple[set[Span], set[str]]] = {}

    def bind(self, name: str, value: tuple[set[Span], set[str]], fresh: bool, adds: bool) -> None:
        at = next((names for _, names in reversed(self.scopes) if name in names), None)
        if adds and at is not None:
            value = (at[name][0] | value[0], at[name][1] | value[1])
        (self.scopes[-1][1] if fresh or at is None else at)[name] = value
        self.last[name] = value

    def look_up(self, name: str) -> tuple[set[Span], set[str]] | None:
        return next((names[name] for _, names in reversed(self.scopes) if name in names), None)

    def close(self, indent: int | None) -> None:
        """Ends a scope of braces, or the bodies that a line with this indentation is outside of."""
        if indent is None:
            at = next((k for k in range(len(self.scopes) - 1, 0, -1) if self.scopes[k][0] is None), 0)
            del self.scopes[at or len(self.scopes) :]
        while len(self.scopes) > 1 and self.scopes[-1][0] is not None and indent is not None and indent <= self.scopes[-1][0]:
            self.scopes.pop()


class Lexer:
    def __init__(self, text: str):
        self.text, self.names = text, Bindings()
        self.spans: set[tuple[int, int, str]] = set()
        self.bare: set[Span] = set()
        self.late: list[tuple[float, set[str]]] = []  # weights of targets and names still to be resolved
        self.unclosed: set[str] = set()

    def value(self, at: int) -> tuple[set[Span], set[str], int]:
        """Literal spans and references of the value at a place, and where it ends."""
        literals, refs, text = set(), set(), self.text
        while (m := _VALUE.match(text, at)) is not None:
            at = m.end()
            kind = m.lastgroup
            if kind == "triple":
                end = -1 if m[kind] in self.unclosed else text.find(m[kind], at)
                if end < 0:
                    self.unclosed.add(m[kind])
                    break
                literals.add((at, end))
                at = end + 3
            elif kind == "ref":
                refs.add(m[kind])
            elif kind == "bare":
                if text[at : at + 1] == "(":
                    break
                start, end = m.span(kind)
                if _NAME.match(m[kind]):
                    refs.add(m[kind])
                self.bare.add((start, end))
                literals.add((start, end))
            else:
                literals.add(m.span(kind))
            more = _PLUS.match(text, at)
            if more is None:
                break
            at = more.end()
        return literals, refs, at

    def assign(self, name: str, literals: set[Span], refs: set[str], fresh: bool = False, adds: bool = False) -> None:
        found, late = set(literals), set()
        for r in refs:
            known = self.names.look_up(r) if r != name else None
            if known is None:
                late.add(r)
            else:
                # A bare word that names something isn't a literal.
                found -= {s for s in found if s in self.bare and self.text[s[0] : s[1]] == r}
                found |= known[0]
                late |= known[1]
        self.names.bind(name, (found, late), fresh, adds)
        self.score(name_weight(name), found, late)

    def score(self, weight: float, found: set[Span], late: set[str]) -> None:
        if weight < MIN_SCORE - 1:
            return
        if late:
            self.late.append((weight, late))
        for a, b in found:
            literal = self.text[a:b]
            if (a, b) in self.bare and literal in late:
                continue  # settled at the end
            if is_secret(literal, weight, (a, b) not in self.bare):
                self.spans.add((a, b, "literal"))

    def run(self) -> list[tuple[int, int, str]]:
        at, text, line, seen = 0, self.text, 0, False
        while (m := _STATEMENT.search(text, at)) is not None:
            begin = text.rfind("\n", at, m.start()) + 1
            if begin:
                line, seen = begin, False
            at = m.end()
            body = m.start() + len(m[0]) - len(m[0].lstrip())
            if not seen and m["open"] is None and m["close"] is None:
                seen = True
                if not text[line:body].strip():
                    self.names.close(body - line)
            if m["open"]:
                self.names.scopes.append((None, {}))
            elif m["close"]:
                self.names.close(None)
            elif m["def"]:
                self.names.scopes.append((body - line, {}))
            elif m["tag"]:
                self.element(m)
            else:
                literals, refs, at = self.value(at)
                name = m["declared"] or m["item"] or m["key"] or m["name"]
                operator = m[0].rstrip(" \t")
                self.assign(name, literals, refs, bool(m["declared"]) or operator.endswith(":="), operator.endswith("+="))
        for weight, names in self.late:
            todo, seen = list(names), set(names)
            while todo:
                found, more = self.names.last.get(todo.pop(), (set(), set()))
                self.score(weight, {s for s in found if not (s in self.bare and text[s[0] : s[1]] in self.names.last)}, set())
                todo += more - seen
                seen |= more
        # Bare words of sensitive targets that name nothing are literals after all.
        for name, (found, _) in self.names.last.items():
            words = {s for s in found if s in self.bare and text[s[0] : s[1]] not in self.names.last}
            self.score(name_weight(name), words, set())
        return list(self.spans)

    def element(self, m: re.Match) -> None:
        """An element's text belongs to its name, or to what its attributes call it; so do the attributes' values."""
        named = {k.lower(): (v or w) for k, v, w in _ATTRIBUTE.findall(m["attrs"])}
        name = next((named[k] for k in ("key", "name", "id") if named.get(k)), m["tag"])
        start = m.end()
        end = self.text.find("<", start)
        if end > start and self.text.startswith(f"</{m['tag']}", end):
            inner = self.text[start:end]
            a = start + len(inner) - len(inner.lstrip())
            self.assign(name, {(a, start + len(inner.rstrip()))}, set())
        for x in _ATTRIBUTE.finditer(m["attrs"]):
            span = x.span(2 if x[2] is not None else 3)
            self.assign(name if x[1].lower() == "value" else x[1], {span}, set())


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach sensitive target names, directly or through constants."""
    return Lexer(text).run() if _ANY.search(text) else []


def _joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans."""
    text = text or ""
    base = base_spans(text)
    more = literal_spans(text) if "=" in text or ":" in text else []
    n = Counter(s[2] for s in base)
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return n["assign"], n["access"], n["hex"], digest, _joined(base + more)


@F.arrow_udf(struct("n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))
def _scan(text: pa.Array) -> pa.Array:
    rows = [scan(t) for t in text.to_pylist()]
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def find_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans to the documents; columns of these names are replaced.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind; the base spans are always
    among them.  A base span is the whole match.  Null and empty texts have no spans, and the digest of an empty list.
    Spans that tie at their start come in the order assign, access, hex, literal.  Very long texts are scanned whole.
    Rows are scanned one by one, so repeated rows agree; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    names = [c for c in docs.columns if c not in added]
    out = docs.select(F.struct(*names).alias("row"), _scan(F.col(text_column)).alias("new"))
    return out.select(*(F.col(f"row.`{n}`").alias(n) for n in names), *(F.col(f"new.{n}") for n in added))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span written over by asterisks, as DataFrame functions."""
    starts = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    blank = lambda t, s: F.concat(
        F.substring(t, F.lit(1), s[1].cast("int")),
        F.repeat(F.lit("*"), s[2].cast("int") - s[1].cast("int")),
        F.substring(t, s[2].cast("int") + 1, F.char_length(t)),
    )
    return F.aggregate(starts, text, blank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

