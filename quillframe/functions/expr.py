"""Deferred column expressions.

An ``Expr`` is a small tree that becomes a Spark ``Column`` once a frame is given.  The tree is needed since
the meaning of ``/``, ``%``, ``&`` and of type errors depends on operand types; it never evaluates anything.

Null rules: arithmetic, comparisons, ``&`` and ``|`` give null if either operand is null (so ``null & false``
is null); ``is_null`` and ``is_not_null`` never give null.  Integer division truncates toward zero, and
division or remainder by zero gives 0; division of floats follows IEEE 754.  ``length`` counts bytes;
``to_lower`` and ``to_upper`` change ASCII letters only.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe import types as qt

ARITHMETIC = ("+", "-", "*", "/", "%")
COMPARISON = ("==", "!=", "<", "<=", ">", ">=")
WHOLE_TABLE = ("sum", "mean", "count", "min", "max")


@dataclass(frozen=True)
class Bound:
    """A Spark column with the type that the rules of this module give it."""

    column: Column
    dtype: T.DataType


class Node:
    def bind(self, df: DataFrame) -> Bound:
        raise NotImplementedError


@dataclass(frozen=True)
class Name(Node):
    name: str

    def bind(self, df: DataFrame) -> Bound:
        if self.name not in df.columns:
            raise KeyError(f"Column not found: {self.name}")
        return Bound(qt.quoted(self.name), df.schema[self.name].dataType)

    def __str__(self) -> str:
        return f'col("{self.name}")'


@dataclass(frozen=True)
class Literal(Node):
    value: object
    dtype: T.DataType

    def bind(self, df: DataFrame) -> Bound:
        return Bound(F.lit(self.value).cast(self.dtype), self.dtype)

    def __str__(self) -> str:
        if qt.is_string(self.dtype):
            return f'lit("{self.value}")'
        if qt.is_bool(self.dtype):
            return f"lit({str(self.value).lower()})"
        return f"lit({self.value}{'L' if self.dtype == qt.LONG else ''})"


def _both(left: Column, right: Column, value: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), value)


def _ieee_divide(a: Column, b: Column) -> Column:
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    negative = (a > 0) == (b.cast("string") == "-0.0")
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when(negative, -inf).otherwise(inf)
    return _both(a, b, F.when(b == 0, by_zero).otherwise(a / b))


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def bind(self, df: DataFrame) -> Bound:
        left, right = self.left.bind(df), self.right.bind(df)
        if self.op in ("&", "|"):
            return self._logical(left, right)
        if self.op in COMPARISON:
            return self._compare(left, right)
        return self._arithmetic(left, right)

    def _logical(self, left: Bound, right: Bound) -> Bound:
        if not (qt.is_bool(left.dtype) and qt.is_bool(right.dtype)):
            raise TypeError(f"{self.op} requires boolean operands: {self}")
        value = left.column & right.column if self.op == "&" else left.column | right.column
        return Bound(_both(left.column, right.column, value), qt.BOOL)

    def _compare(self, left: Bound, right: Bound) -> Bound:
        a, b = left.column, right.column
        if qt.is_numeric(left.dtype) and qt.is_numeric(right.dtype):
            common = qt.promote(left.dtype, right.dtype)
            a, b = (x.column if qt.rung(x.dtype) == common else x.column.cast(common) for x in (left, right))
        elif qt.is_string(left.dtype) and qt.is_string(right.dtype):
            if self.op not in ("==", "!="):
                raise TypeError(f"strings compare with == and != only: {self}")
        elif left.dtype != right.dtype or qt.is_bool(left.dtype):
            raise TypeError(f"{self.op} requires numeric operands: {self}")
        column = {
            "==": lambda: a == b,
            "!=": lambda: a != b,
            "<": lambda: a < b,
            "<=": lambda: a <= b,
            ">": lambda: a > b,
            ">=": lambda: a >= b,
        }[self.op]()
        return Bound(column, qt.BOOL)

    def _arithmetic(self, left: Bound, right: Bound) -> Bound:
        if not (qt.is_numeric(left.dtype) and qt.is_numeric(right.dtype)):
            raise TypeError(f"{self.op} requires numeric operands: {self}")
        common = qt.promote(left.dtype, right.dtype)
        a, b = left.column.cast(common), right.column.cast(common)
        if self.op in ("+", "-", "*"):
            column = a + b if self.op == "+" else a - b if self.op == "-" else a * b
        elif self.op == "%":
            if not qt.is_integral(common):
                raise TypeError(f"% requires integer operands: {self}")
            column = _both(a, b, F.when(b == 0, F.lit(0).cast(common)).otherwise(a % b))
        elif qt.is_integral(common):
            # The quotient's own guard keeps ANSI mode from raising before the outer branch is chosen.
            quotient = F.call_function("div", a, F.when(b != 0, b))
            column = _both(a, b, F.when(b == 0, F.lit(0).cast(common)).otherwise(quotient.cast(common)))
        else:
            column = _ieee_divide(a, b).cast(common)
        return Bound(column, common)

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    child: Node

    def bind(self, df: DataFrame) -> Bound:
        x = self.child.bind(df)
        c = x.column
        if self.op in ("is_null", "is_not_null"):
            return Bound(c.isNull() if self.op == "is_null" else c.isNotNull(), qt.BOOL)
        if self.op in ("abs", "neg"):
            if not qt.is_numeric(x.dtype):
                raise TypeError(f"{self.op} requires a numeric operand: {self}")
            return Bound(F.abs(c) if self.op == "abs" else -c, x.dtype)
        if self.op == "not":
            if not qt.is_bool(x.dtype):
                raise TypeError(f"~ requires a boolean operand: {self}")
            return Bound(~c, qt.BOOL)
        if not qt.is_string(x.dtype):
            raise TypeError(f"{self.op} requires a string operand: {self}")
        if self.op == "length":
            return Bound(F.octet_length(c), qt.INT)
        # Plain ASCII, told by its length, takes Spark's much faster case functions.
        plain = F.octet_length(c) == F.char_length(c)
        if self.op == "to_lower":
            return Bound(F.when(plain, F.lower(c)).otherwise(F.translate(c, ascii_uppercase, ascii_lowercase)), qt.STRING)
        return Bound(F.when(plain, F.upper(c)).otherwise(F.translate(c, ascii_lowercase, ascii_uppercase)), qt.STRING)

    def __str__(self) -> str:
        return f"{self.op}({self.child})"


@dataclass(frozen=True)
class Match(Node):
    op: str
    child: Node
    needle: str

    def bind(self, df: DataFrame) -> Bound:
        x = self.child.bind(df)
        if not qt.is_string(x.dtype):
            raise TypeError(f"{self.op} requires a string operand: {self}")
        needle = F.lit(self.needle)
        if self.op == "contains":
            return Bound(x.column.contains(needle), qt.BOOL)
        if self.op == "starts_with":
            return Bound(x.column.startswith(needle), qt.BOOL)
        return Bound(x.column.endswith(needle), qt.BOOL)

    def __str__(self) -> str:
        return f'{self.child}.{self.op}("{self.needle}")'


@dataclass(frozen=True)
class WholeTable(Node):
    """An aggregate over all rows of the frame, as a scalar that every row sees."""

    op: str
    child: Node

    def bind(self, df: DataFrame) -> Bound:
        x = self.child.bind(df)
        column, dtype = aggregate_column(self.op, x.column, x.dtype)
        return Bound(df.select(column).scalar(), dtype)

    def __str__(self) -> str:
        return f"{self.child}.{self.op}()"


@dataclass(frozen=True)
class Alias(Node):
    child: Node
    label: str

    def bind(self, df: DataFrame) -> Bound:
        return self.child.bind(df)

    def __str__(self) -> str:
        return f'{self.child}.alias("{self.label}")'


def aggregate_column(op: str, column: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """The aggregate and its type, for a whole table or a group: sums widen, means are double, counts are long."""
    if op == "count":
        return F.count(column), qt.LONG
    if op in ("min", "max"):
        return (F.min(column) if op == "min" else F.max(column)), dtype
    if op not in ("sum", "mean"):
        raise ValueError(f"unknown aggregate {op!r}; expected one of {', '.join(WHOLE_TABLE)}")
    if not qt.is_numeric(dtype):
        raise TypeError(f"{op} requires a numeric column, not {dtype.simpleString()}")
    if op == "mean":
        return F.avg(column).cast(qt.DOUBLE), qt.DOUBLE
    # A decimal's sum is exact before it becomes a double.
    return (F.sum(column), qt.LONG) if qt.is_integral(dtype) else (F.sum(column).cast(qt.DOUBLE), qt.DOUBLE)


class Expr:
    """A value class over a node; Python operators build larger expressions."""

    __slots__ = ("node",)
    __hash__ = None

    def __init__(self, node: Node | None = None):
        self.node = node

    def valid(self) -> bool:
        return self.node is not None

    def evaluate(self, frame) -> Column:
        """The Spark column of this expression on a frame or a DataFrame."""
        return self.bind(getattr(frame, "df", frame)).column

    def bind(self, df: DataFrame) -> Bound:
        if self.node is None:
            raise ValueError("the expression is empty")
        return self.node.bind(df)

    def to_string(self) -> str:
        return str(self.node)

    __str__ = to_string

    def __repr__(self) -> str:
        return f"Expr({self.node})"

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~ instead of and, or, not")

    def abs(self) -> Expr:
        return Expr(Unary("abs", self.node))

    def is_null(self) -> Expr:
        return Expr(Unary("is_null", self.node))

    def is_not_null(self) -> Expr:
        return Expr(Unary("is_not_null", self.node))

    def length(self) -> Expr:
        return Expr(Unary("length", self.node))

    def to_lower(self) -> Expr:
        return Expr(Unary("to_lower", self.node))

    def to_upper(self) -> Expr:
        return Expr(Unary("to_upper", self.node))

    def contains(self, needle: str) -> Expr:
        return Expr(Match("contains", self.node, needle))

    def starts_with(self, needle: str) -> Expr:
        return Expr(Match("starts_with", self.node, needle))

    def ends_with(self, needle: str) -> Expr:
        return Expr(Match("ends_with", self.node, needle))

    def sum(self) -> Expr:
        return Expr(WholeTable("sum", self.node))

    def mean(self) -> Expr:
        return Expr(WholeTable("mean", self.node))

    def count(self) -> Expr:
        return Expr(WholeTable("count", self.node))

    def min(self) -> Expr:
        return Expr(WholeTable("min", self.node))

    def max(self) -> Expr:
        return Expr(WholeTable("max", self.node))

    def alias(self, label: str) -> Expr:
        """Labels the expression in ``to_string``; the output name comes from ``with_column``."""
        return Expr(Alias(self.node, label))

    def __neg__(self) -> Expr:
        return Expr(Unary("neg", self.node))

    def __invert__(self) -> Expr:
        return Expr(Unary("not", self.node))


def _operator(op: str, swapped: bool = False):
    def method(self: Expr, other: object) -> Expr:
        right = other.node if isinstance(other, Expr) else lit(other).node
        return Expr(Binary(op, right, self.node) if swapped else Binary(op, self.node, right))

    return method


for _name, _op in zip(("add", "sub", "mul", "truediv", "mod"), ARITHMETIC, strict=True):
    setattr(Expr, f"__{_name}__", _operator(_op))
    setattr(Expr, f"__r{_name}__", _operator(_op, swapped=True))
for _name, _op in zip(("eq", "ne", "lt", "le", "gt", "ge"), COMPARISON, strict=True):
    setattr(Expr, f"__{_name}__", _operator(_op))
for _name, _op in (("and", "&"), ("or", "|")):
    setattr(Expr, f"__{_name}__", _operator(_op))
    setattr(Expr, f"__r{_name}__", _operator(_op, swapped=True))


def col(name: str) -> Expr:
    """The column of exactly this name (case-sensitive)."""
    return Expr(Name(name))


def lit(value: object, dtype: T.DataType | None = None) -> Expr:
    """A constant: bool, int (32 bits if it fits), float (double) or str; ``dtype`` overrides the type."""
    return Expr(Literal(value, dtype or qt.literal_type(value)))
