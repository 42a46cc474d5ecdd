"""A compact dataframe API on Spark, with an eager and a lazy face."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillframe.functions.expr import Expr, col, lit
from quillframe.operators.frame import EagerFrame, Frame, LazyFrame
from quillframe.operators.grouped import GroupedFrame
from quillframe.plans.trace import Step
from quillframe.sources import columns as _columns
from quillframe.sources import csv as _csv
from quillframe.sources import parquet as _parquet

__all__ = [
    "EagerFrame", "Expr", "Frame", "GroupedFrame", "LazyFrame", "col", "from_columns", "lit", "read_csv",
    "read_parquet", "scan_csv", "scan_parquet",
]


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def scan_csv(
    path: str, columns: Sequence[str] | None = None, spark: SparkSession | None = None, schema: T.StructType | None = None
) -> LazyFrame:
    """A lazy frame over a CSV file with a header; see ``quillframe.sources.csv`` for types and nulls."""
    return LazyFrame(_csv.read_csv(_session(spark), path, columns, schema), Step(f"scan csv {path}"))


def scan_parquet(path: str, columns: Sequence[str] | None = None, spark: SparkSession | None = None) -> LazyFrame:
    return LazyFrame(_parquet.read_parquet(_session(spark), path, columns), Step(f"scan parquet {path}"))


def read_csv(
    path: str, columns: Sequence[str] | None = None, spark: SparkSession | None = None, schema: T.StructType | None = None
) -> EagerFrame:
    return scan_csv(path, columns, spark, schema).collect()


def read_parquet(path: str, columns: Sequence[str] | None = None, spark: SparkSession | None = None) -> EagerFrame:
    return scan_parquet(path, columns, spark).collect()


def from_columns(columns: Sequence[tuple[str, object]], spark: SparkSession | None = None) -> EagerFrame:
    return EagerFrame(_columns.from_columns(_session(spark), columns), Step("columns"))
