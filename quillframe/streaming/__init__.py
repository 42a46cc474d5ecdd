"""Frames over streams: the row-wise operators and grouped aggregates of a frame apply to them unchanged."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillframe.operators.frame import LazyFrame
from quillframe.plans.trace import Step


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> LazyFrame:
    """A frame of the rows of Parquet files as they arrive in a folder; write its ``df`` with ``writeStream``."""
    return LazyFrame(spark.readStream.schema(schema).parquet(path), Step(f"stream parquet {path}"))
