"""Column expressions and how they bind to Spark columns."""

from quillframe.functions.expr import Expr, col, lit

__all__ = ["Expr", "col", "lit"]
