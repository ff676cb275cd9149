"""Tables kept between runs: fetched once, written as a whole or not at all, read from then on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    """The file system of a path and a maker of paths on it; any that Spark can write to."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def is_kept(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there to its end."""
    files, path = _files(spark, folder)
    return files.exists(path(f"{folder}/_SUCCESS"))


def keep(table: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Write a table beside ``folder`` and move it there once all its tasks are committed, in place of what was there.

    ``kind`` is ``parquet`` or ``csv``, which is compressed with gzip. A job that fails leaves ``folder`` as it was.
    """
    spark = table.sparkSession
    files, path = _files(spark, folder)
    part = f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        if kind == "csv":
            table.write.option("header", True).option("compression", "gzip").option("emptyValue", '""').csv(part)
        else:
            table.write.format(kind).save(part)
        files.delete(path(folder), True)
        if not files.rename(path(part), path(folder)):
            raise OSError(f"{part} cannot be moved to {folder}")
    finally:
        files.delete(path(part), True)


def kept(spark: SparkSession, folder: str, make: Callable[[], DataFrame], kind: str = "parquet", refresh: bool = False) -> DataFrame:
    """The table in ``folder``; where there is none, or with ``refresh``, it is made and kept first. Types of CSV are inferred."""
    if refresh or not is_kept(spark, folder):
        keep(make(), folder, kind)
    reader = spark.read.format(kind)
    return (reader.option("header", True).option("inferSchema", True) if kind == "csv" else reader).load(folder)


def resolve(spark: SparkSession, source: str | None, folder: str, make: Callable[[], DataFrame] | None = None) -> str:
    """Where to read from: ``source``, which must exist, or ``folder``, into which ``make`` is written if nothing was kept there."""
    if source is not None:
        files, path = _files(spark, source)
        if not files.exists(path(source)):
            raise ValueError(f"there is no {source}")
        return source
    if not is_kept(spark, folder):
        if make is None:
            raise ValueError(f"nothing is kept in {folder}, and no source is given")
        keep(make(), folder)
    return folder
