"""Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quillframe import types as qt


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns, or those of the named ones that exist; if none of them does, all."""
    df = spark.read.parquet(path)
    known = [c for c in columns or () if c in df.columns]
    return df.select(*map(qt.quoted, known)) if known else df
