"""Folders for intermediate tables, on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (``local[…]``) gets a temporary folder; on a cluster it is an error, as
    executors wouldn't share one.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        named = getattr(spark, "_quillframe_folder", None) or tempfile.mkdtemp(prefix="quillframe-")
        spark._quillframe_folder = named
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet and read again: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quillframe_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more; others are left alone."""
    for df in tables:
        if not hasattr(df, "_quillframe_path"):
            continue
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quillframe_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
