"""A Pareto archive kept up by a stream: each micro-batch meets the front so far."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evoframe.operators.pareto import front_of_two


def keep_front(stream: DataFrame, folder: str, f1: str, f2: str, key: str, checkpoint: str):
    """Start the query that writes the front after each batch to ``folder/<batch>``; the last folder is the archive."""

    def merge(batch: DataFrame, number: int) -> None:
        held = batch
        if number:  # batches are numbered from 0 without gaps, so a restarted query finds the front before
            held = batch.sparkSession.read.parquet(f"{folder}/{number - 1:010d}").unionByName(batch)
        front_of_two(held, f1, f2, key).write.mode("overwrite").parquet(f"{folder}/{number:010d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
