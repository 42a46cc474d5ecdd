"""Frames from columns in memory."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def from_columns(spark: SparkSession, columns: Sequence[tuple[str, object]]) -> DataFrame:
    """Pairs of a name and an Arrow array (or a list); lengths must agree and names must differ."""
    names = [n for n, _ in columns]
    if len(set(names)) != len(names):
        raise ValueError("from_columns needs unique names")
    arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for _, a in columns]
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("from_columns needs columns of one length")
    return spark.createDataFrame(pa.table(arrays, names=names))
