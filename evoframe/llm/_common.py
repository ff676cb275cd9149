"""What the operators of this subpackage share: the shared folder, cut lineage, batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 1 << 20
#: Bits of the filter that ``likely_in`` broadcasts, 64 to a row.
FILTER_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        # one machine: the driver's own folders are everyone's
        base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/evoframe-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, so a lost one costs no more than its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """Give memory that is free in this worker back to the machine: the allocators would keep it until the worker ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def per_batch(function: Callable[[pd.DataFrame], pd.DataFrame]):
    """Turn a function of one pandas batch into what ``mapInPandas`` takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield function(batch)
                give_back()

    return run


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further or clashing ones never matter."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has about ``most`` bytes in a column, and one row at least.

    Spark bounds a batch in bytes already; this bounds what is held as Python objects.
    """
    for batch in batches:
        at, rows = 0, batch.num_rows
        while at < rows:
            n = rows - at
            while n > 1 and batch.column(column)[at : at + n].nbytes > most:
                n = max(1, min(n // 2, int(n * most / batch.column(column)[at : at + n].nbytes)))
            yield batch.slice(at, n)
            at += n
        give_back()


def per_slice(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"):
    """Turn a function of one slice into what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, column):
            yield function(part)

    return run


def arrow_rows(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of the rows, also of none."""
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, fields.values())], list(fields))


def likely_in(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` whose ``column`` is among the keys, and few others: a filter in front of a join.

    A bit for each hash of a key; the words of bits, ``2**(bits - 6)`` rows at most whatever
    the number of keys, are broadcast. So rows without a partner are not shuffled. With far
    more keys than bits it lets all through, which costs time but no row.
    """

    def hashed(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))

    set_bits = keys.select(hashed(key).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word"))
    words = set_bits.agg(F.bit_or(F.expr("shiftleft(1L, int(_h % 64))")).alias("_bits"))
    marked = rows.withColumn("_h", hashed(column)).withColumn("_word", F.shiftright("_h", 6))
    found = marked.join(F.broadcast(words), "_word").where(F.expr("shiftrightunsigned(_bits, int(_h % 64)) & 1L = 1"))
    return found.select(*rows.columns)


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` as ``row``, one struct of all their columns, beside the named keys: no name can clash with what is added."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in keys])


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``packed`` again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])
