"""Helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words and pad lines: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes in an Arrow batch; texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 500, 4 * 2**20
LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it holds more than one in ``HOT_SHARE`` rows, and ``LEAST_HOT`` at least: there are never more hot keys
#: than ``HOT_SHARE``.  Rows of a hot key are dealt over ``SALTS`` tasks.
HOT_SHARE, LEAST_HOT, SALTS = 1000, 300, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that are sent to a Python worker at once, and with them its memory.

    All operators set the same values, so it doesn't matter which of them was built last when a plan runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and no other letter; plain ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UP, LOW))


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; it deals rows to folds.  A null id counts as empty."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def ticket(*columns: str | Column) -> Column:
    """A number from 0 to 1 that the values of the columns decide, with 53 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(2.0**53)


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind until no column of ``taken`` is called so in either case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


class Spread:
    """Joins of a table that may have hot keys with one that has a row for each key at most.

    Hot keys are found by a count of ``counted``, which must have the keys as the joined table will.  The table's rows
    of a hot key are dealt by a hash of the row, the other table's row is repeated for each part.  The hash depends on
    the row alone, so that a task that runs again deals its rows as before.
    """

    def __init__(self, counted: DataFrame, keys: list[str], total: int | None = None):
        """counted: the rows themselves, or with a column ``n`` and ``total`` given, a row and its count for each key."""
        self.keys = keys
        if total is None:
            counted, total = counted.groupBy(*keys).agg(F.count("*").alias("n")), counted.count()
        hot = counted.filter(F.col("n") > max(LEAST_HOT, total // HOT_SHARE)).select(*keys)
        rows = hot.collect()  # fewer than HOT_SHARE rows, or than total / LEAST_HOT
        self.hot = counted.sparkSession.createDataFrame(rows, hot.schema) if rows else None

    def join(self, many: DataFrame, one: DataFrame, how: str = "inner", by: list[Column] | None = None) -> DataFrame:
        """how: inner or left; by: what the rows of a hot key are dealt by, all columns if not given."""
        if self.hot is None:
            return many.join(one, self.keys, how)
        hot, zero = F.broadcast(self.hot.withColumn("is_hot", F.lit(True))), F.lit(0).cast("long")
        part = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*(by or many.columns)), F.lit(SALTS).cast("long"))).otherwise(zero)
        dealt = many.join(hot, self.keys, "left").withColumn("salt", part).drop("is_hot")
        parts = F.when(F.col("is_hot"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))
        copies = one.join(hot, self.keys, "left").withColumn("salt", F.explode(parts)).drop("is_hot")
        return dealt.join(copies, [*self.keys, "salt"], how).drop("salt")


def struct(fields: str) -> T.StructType:
    """A struct type from ``name type, …`` with types long, string, double, int, boolean, long[] and binary; unlike
    Spark's own parser it needs no session, so it can stand in decorators."""
    kinds = {
        "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
        "boolean": T.BooleanType(), "long[]": T.ArrayType(T.LongType()), "binary": T.BinaryType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(","))])
