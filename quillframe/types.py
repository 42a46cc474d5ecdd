"""Type rules shared by the expression binder and the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, LONG, FLOAT, DOUBLE = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
STRING, BOOL = T.StringType(), T.BooleanType()

#: Promotion order, weakest first; LONG with FLOAT gives FLOAT.
LADDER = (INT, LONG, FLOAT, DOUBLE)
INT32_RANGE = range(-(2**31), 2**31)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_bool(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def rung(dtype: T.DataType) -> T.DataType:
    """The ladder type that a numeric type computes in."""
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return INT
    if isinstance(dtype, T.DecimalType):
        return DOUBLE
    return dtype


def promote(left: T.DataType, right: T.DataType) -> T.DataType:
    return max(rung(left), rung(right), key=LADDER.index)


def literal_type(value: object) -> T.DataType:
    """bool before int, as a Python bool is an int."""
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT if value in INT32_RANGE else LONG
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    raise TypeError(f"no literal type for {type(value).__name__}")


def quoted(name: str) -> Column:
    """The column of exactly this name; dots and backticks are plain characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: list[str], stem: str, n: int) -> list[str]:
    """n names that no column of ``taken`` has in either case."""
    used, at, out = {t.lower() for t in taken}, 0, []
    while len(out) < n:
        if f"{stem}_{at}" not in used:
            out.append(f"{stem}_{at}")
        at += 1
    return out
