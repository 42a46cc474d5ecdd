"""Grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from quillframe import types as qt
from quillframe.functions.expr import aggregate_column

if TYPE_CHECKING:
    from quillframe.operators.frame import Frame


class GroupedFrame:
    """A frame and its grouping keys; nothing runs until ``aggregate``."""

    def __init__(self, frame: Frame, keys: Sequence[str]):
        self.frame, self.keys = frame, list(keys)

    def aggregate(self, aggregates: Sequence[tuple[str, str]]) -> Frame:
        """Keys in the order given, then ``<column>_<function>`` for each pair, with nulls skipped.

        Rows with a null key form a group, except that a single string key drops them.  Functions: sum (long for
        integers, else double), mean (double), count (long), min and max (the column's type).
        """
        if not self.keys:
            raise ValueError("group_by needs at least one key")
        df = self.frame.df
        self.frame.require([*self.keys, *(name for name, _ in aggregates)])
        columns = []
        for name, func in aggregates:
            column, _ = aggregate_column(func, qt.quoted(name), df.schema[name].dataType)
            columns.append(column.alias(f"{name}_{func}"))
        if len(self.keys) == 1 and qt.is_string(df.schema[self.keys[0]].dataType):
            df = df.filter(qt.quoted(self.keys[0]).isNotNull())
        keys = [qt.quoted(k).alias(k) for k in self.keys]
        result = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
        label = f"aggregate [{', '.join(self.keys)}] {', '.join(f'{f}({c})' for c, f in aggregates)}"
        return self.frame.derive(result, label)
