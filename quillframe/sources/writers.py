"""CSV and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillframe.sources.csv import DIALECT


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    _write(df, path, single_file, lambda w, to: w.csv(to, header=True, **DIALECT))


def write_parquet(df: DataFrame, path: str, single_file: bool = False) -> None:
    _write(df, path, single_file, lambda w, to: w.parquet(to))


def _write(df: DataFrame, path: str, single_file: bool, write) -> None:
    if not single_file:
        write(df.write.mode("overwrite"), path)
        return
    staging = f"{path.rstrip('/')}.staging"
    write(df.coalesce(1).write.mode("overwrite"), staging)
    # Hadoop's file system API, so that any store Spark can write to works.
    jvm = df.sparkSession.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(hadoop(staging)) if s.getPath().getName().startswith("part-")]
    fs.delete(target, True)
    fs.rename(parts[0], target)
    fs.delete(hadoop(staging), True)
