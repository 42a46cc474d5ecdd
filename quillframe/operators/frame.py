"""Frames: thin values over Spark DataFrames.

``Frame`` holds the operators.  ``LazyFrame`` adds ``collect``, ``explain`` and sinks, ``EagerFrame`` adds row
counts, printing and writers.  Both build one Catalyst plan; names and types are checked when a method is called, so
that the two faces agree.  Rows have no order but for what ``sort`` gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe import types as qt
from quillframe.functions.expr import Expr
from quillframe.functions.predicate import bind_filter
from quillframe.operators.grouped import GroupedFrame
from quillframe.plans.trace import Step, render, to_dot
from quillframe.sources import writers

Self = TypeVar("Self", bound="Frame")
JOINS = {"inner": "inner", "left": "left", "outer": "full"}


class Frame:
    def __init__(self, df: DataFrame, step: Step | None = None):
        self.df = df
        self.step = step or Step("dataframe")

    def derive(self: Self, df: DataFrame, label: str, *others: Frame) -> Self:
        return type(self)(df, Step(label, (self.step, *(o.step for o in others))))

    def require(self, names: Sequence[str]) -> None:
        if missing := [n for n in names if n not in self.df.columns]:
            raise KeyError(f"Column not found: {', '.join(missing)}")
        if several := [n for n in dict.fromkeys(names) if self.df.columns.count(n) > 1]:
            raise KeyError(f"Several columns are called {', '.join(several)}")

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def select(self: Self, names: Sequence[str]) -> Self:
        """Columns by name, in the order given; repeats are allowed, but can't be named again."""
        self.require(names)
        return self.derive(self.df.select(*map(qt.quoted, names)), f"select {', '.join(names)}")

    def filter(self: Self, predicate: Expr) -> Self:
        """Rows whose predicate is true; false and null are dropped."""
        return self.derive(self.df.filter(bind_filter(predicate, self.df)), f"filter {predicate}")

    def with_column(self: Self, name: str, expr: Expr) -> Self:
        """Replaces the column in place if the name exists, else appends it."""
        value = expr.bind(self.df).column
        columns = [value.alias(n) if n == name else qt.quoted(n) for n in self.df.columns]
        if name not in self.df.columns:
            columns.append(value.alias(name))
        return self.derive(self.df.select(*columns), f"with_column {name} = {expr}")

    def _order(self, names: Sequence[str], ascending: bool) -> list:
        self.require(names)
        keys = [qt.quoted(n) for n in names]
        return [k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys]

    def sort(self: Self, names: Sequence[str], ascending: bool = True) -> Self:
        """One direction for all keys, nulls last in both; no keys leave the frame as it is."""
        if not names:
            return self
        way = "asc" if ascending else "desc"
        return self.derive(self.df.orderBy(*self._order(names, ascending)), f"sort {', '.join(names)} {way}")

    def head(self: Self, n: int) -> Self:
        """The first n rows; after ``sort`` it plans as a top-k without a full sort."""
        if n < 0:
            raise ValueError("head needs n >= 0")
        return self.derive(self.df.limit(n), f"head {n}")

    def sort_top_n(self: Self, names: Sequence[str], ascending: bool, n: int) -> Self:
        """As ``sort`` then ``head``, over all keys; n below 1 gives no rows."""
        return self.sort(names, ascending).head(max(n, 0))

    def join(self: Self, other: Frame, on: Sequence[str], how: str = "inner") -> Self:
        """Equi-join on all the shared names in ``on``; null keys never match.

        Output: all left columns, then the right ones but the keys, with ``_right`` added to names that the left
        has.  ``how``: inner, left, or outer (full; its keys are taken from the side that has them).
        """
        on = [on] if isinstance(on, str) else list(on)
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}; expected one of {', '.join(JOINS)}")
        if not on:
            raise ValueError("join needs at least one key")
        self.require(on)
        other.require(on)
        for k in on:
            a, b = self.df.schema[k].dataType, other.df.schema[k].dataType
            if a != b:
                raise TypeError(f"join key {k} is {a.simpleString()} on the left, {b.simpleString()} on the right")
        left = self.df.columns
        named = {n: f"{n}_right" if n in left else n for n in other.df.columns if n not in on}
        names = [*left, *named.values()]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"join would repeat the names {', '.join(sorted(twice))}")
        keys = dict(zip(on, qt.free_names(names, "key", len(on)), strict=True))
        right = other.df.select(
            *(qt.quoted(k).alias(v) for k, v in keys.items()), *(qt.quoted(n).alias(v) for n, v in named.items())
        )
        match = [qt.quoted(k) == qt.quoted(v) for k, v in keys.items()]
        joined = self.df.join(right, match, JOINS[how])
        key = lambda k: F.coalesce(qt.quoted(k), qt.quoted(keys[k])).alias(k)
        out = [key(n) if how == "outer" and n in keys else qt.quoted(n) for n in left]
        result = joined.select(*out, *map(qt.quoted, named.values()))
        return self.derive(result, f"join {how} on {', '.join(on)}", other)

    def group_by(self, keys: Sequence[str]) -> GroupedFrame:
        return GroupedFrame(self, keys)

    def lazy(self) -> LazyFrame:
        return LazyFrame(self.df, self.step)


class LazyFrame(Frame):
    """A plan that runs when it is collected or written."""

    def collect(self) -> EagerFrame:
        """The frame with its eager face.  Rows stay on the executors."""
        return EagerFrame(self.df, self.step)

    def plan(self) -> Step:
        return self.step

    def dot(self) -> str:
        return to_dot(self.step)

    def explain(self, path: str | None = None) -> str:
        """DOT text of the plan as written; with a path also a PNG there (DOT text if Graphviz is missing)."""
        if path:
            render(self.dot(), path)
        return self.dot()

    def sink_csv(self, path: str, single_file: bool = False) -> None:
        """Writes straight from the plan; see ``EagerFrame.write_csv``."""
        writers.write_csv(self.df, path, single_file)

    def sink_parquet(self, path: str, single_file: bool = False) -> None:
        writers.write_parquet(self.df, path, single_file)


class EagerFrame(Frame):
    def materialize(self) -> EagerFrame:
        """Keeps the rows on the executors for repeated use, spilling to disk."""
        return EagerFrame(self.df.persist(), self.step)

    def num_rows(self) -> int:
        return self.df.count()

    def num_columns(self) -> int:
        return len(self.df.columns)

    def get_table(self):
        """The rows as a ``pyarrow.Table``.  They all come to the driver: for results that fit there."""
        return self.df.toArrow()

    def print(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def write_csv(self, path: str, single_file: bool = False) -> None:
        """Header, quotes doubled, padding kept, null as an empty cell.

        A directory of part files; ``single_file`` has one task write one file, for small results.
        """
        writers.write_csv(self.df, path, single_file)

    def write_parquet(self, path: str, single_file: bool = False) -> None:
        writers.write_parquet(self.df, path, single_file)
