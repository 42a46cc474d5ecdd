"""CSV with exact type and null rules.

A column is int64, boolean, date, timestamp, double or string, the first of these that all its cells fit.  In string
columns every cell is text, so an empty cell is ``""``; elsewhere the null spellings below are null.  A column with
null spellings alone is void.  Types are found by one aggregate over the file; give ``schema`` to skip that pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe import types as qt

DIALECT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# The cell spellings that columnar CSV readers take as null and as booleans.
NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA",
    "NULL", "NaN", "n/a", "nan", "null",
]
TRUE, FALSE = ["1", "true", "True", "TRUE"], ["0", "false", "False", "FALSE"]

INTEGER = r"^-?[0-9]{1,19}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|INF|Infinity|Inf)$"
NTZ = T.TimestampNTZType()


def _fits(c: Column) -> list[tuple[T.DataType, Column]]:
    """For each type, strongest first, whether a cell that isn't null has its form."""
    cast = lambda t: c.try_cast(t).isNotNull()
    return [
        (qt.LONG, c.rlike(INTEGER) & cast("bigint")),
        (qt.BOOL, c.isin(TRUE + FALSE)),
        (T.DateType(), c.rlike(DATE) & cast("date")),
        (NTZ, (c.rlike(STAMP) | c.rlike(DATE)) & cast("timestamp_ntz")),
        (qt.DOUBLE, c.rlike(NUMBER)),
    ]


def infer(raw: DataFrame) -> T.StructType:
    """Types of a frame of raw cells, by one aggregate that returns a single row."""
    checks = []
    for i, name in enumerate(raw.columns):
        c = F.coalesce(qt.quoted(name), F.lit(""))
        blank = c.isin(NULLS)
        checks.append(F.bool_and(blank).alias(f"blank{i}"))
        checks += [F.bool_and(blank | ok).alias(f"fits{i}_{j}") for j, (_, ok) in enumerate(_fits(c))]
    found = raw.agg(*checks).first().asDict() if checks else {}
    types = [t for t, _ in _fits(F.lit(""))]
    fields = []
    for i, name in enumerate(raw.columns):
        dtype: T.DataType = qt.STRING
        if found[f"blank{i}"] is not False:
            dtype = T.NullType()
        else:
            dtype = next((t for j, t in enumerate(types) if found[f"fits{i}_{j}"]), qt.STRING)
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def _typed(name: str, dtype: T.DataType) -> Column:
    c = F.coalesce(qt.quoted(name), F.lit(""))
    if qt.is_string(dtype):
        return c.alias(name)
    if isinstance(dtype, T.NullType):
        return F.lit(None).alias(name)
    value = F.when(~c.isin(NULLS), c)
    if qt.is_bool(dtype):
        return F.when(value.isin(TRUE), True).when(value.isin(FALSE), False).alias(name)
    return value.cast(dtype).alias(name)


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """All columns, or those named (an unknown name is an error), in the order given."""
    raw = spark.read.csv(path, header=True, inferSchema=False, **DIALECT)
    if columns:
        if missing := [c for c in columns if c not in raw.columns]:
            raise KeyError(f"Column not found: {', '.join(missing)}")
        raw = raw.select(*map(qt.quoted, columns))
    types = {f.name: f.dataType for f in (schema or infer(raw))}
    return raw.select(*(_typed(n, types[n]) for n in raw.columns))
