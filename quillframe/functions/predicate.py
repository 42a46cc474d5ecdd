"""Binding of filter predicates.

A filter drops rows whose predicate is null as well as false.  At the root of a filter the strict ``&`` and ``|``
can thus be written without CASE, which keeps the comparisons visible to the scan's ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quillframe import types as qt
from quillframe.functions.expr import Alias, Binary, Expr, Node


def bind_filter(expr: Expr, df: DataFrame) -> Column:
    bound = expr.bind(df)
    if not qt.is_bool(bound.dtype):
        raise TypeError(f"a filter needs a boolean expression, not {bound.dtype.simpleString()}: {expr}")
    return _root(expr.node, df)


def _root(node: Node, df: DataFrame) -> Column:
    if isinstance(node, Alias):
        return _root(node.child, df)
    if isinstance(node, Binary) and node.op == "&":
        return _root(node.left, df) & _root(node.right, df)
    if isinstance(node, Binary) and node.op == "|":
        a, b = node.left.bind(df).column, node.right.bind(df).column
        return (a | b) & a.isNotNull() & b.isNotNull()
    return node.bind(df).column
