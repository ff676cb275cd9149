"""Cleaning with counted filters, replicate collapse and imputation, on long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.metrics import medians

COLLAPSE = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``step_no, step, n``: rows left after each filter and those before it, in one pass."""
    passed, counts = F.lit(True), []
    for number, (name, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.struct(F.lit(number).alias("step_no"), F.lit(name).alias("step"), F.count_if(passed).alias("n")))
    return rows.agg(F.array(*counts).alias("steps")).select(F.inline("steps"))


def collapse(rows: DataFrame, key: str, value: str, first: str, row_id: str, how: str | None = "median", ties: tuple = ()) -> DataFrame:
    """One row for each non-null key: the aggregated value, its first non-null ``first`` and the number of rows.

    ``first`` is that of the smallest ``row_id``; where rows share it, ``ties`` decide.
    """
    known = rows.where(F.col(key).isNotNull())
    if how is None:
        return known.select(key, first, value, F.lit(1).cast("long").alias("n_measurements"))
    firsts = F.min_by(first, F.when(F.col(first).isNotNull() & F.col(row_id).isNotNull(), F.struct(row_id, *ties)))
    return known.groupBy(key).agg(firsts.alias(first), COLLAPSE[how](value).alias(value), F.count(F.lit(1)).alias("n_measurements"))


def label_task(rows: DataFrame, label: str, *keep: str) -> DataFrame:
    """Rows whose label is known, as whole numbers ``y``."""
    return rows.where(F.col(label).isNotNull()).select(*keep, F.col(label).cast("int").alias("y"))


def resolve_task(names: list[str], wanted: str) -> str:
    """A column by its name, or by a part of it that only one name has."""
    if wanted in names:
        return wanted
    found = [n for n in names if wanted.lower() in n.lower()]
    if len(found) != 1:
        raise KeyError(f"{wanted!r} matches {found or 'nothing'}")
    return found[0]


def above(value: Column, threshold: float) -> Column:
    """1 where the value is above the threshold, else 0, for null and NaN too."""
    return F.coalesce(((value > threshold) & ~F.isnan(value.cast("double"))).cast("int"), F.lit(0))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    """``label, n, share`` of each known label."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for a class


def impute(cells: DataFrame, probe: str, value: str, how: str = "mean") -> DataFrame:
    """Missing cells take their probe's mean or median; probes without any value go."""
    by = medians(cells, probe, value, "_fill") if how == "median" else cells.groupBy(probe).agg(COLLAPSE[how](value).alias("_fill"))
    by = by.where(F.col("_fill").isNotNull())
    return cells.join(by, probe).withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def drop_missing(cells: DataFrame, probe: str, value: str, threshold: float) -> DataFrame:
    """Cells of probes of which at most this share is missing."""
    kept = cells.groupBy(probe).agg(F.avg(F.col(value).isNull().cast("int")).alias("_gone")).where(F.col("_gone") <= threshold)
    return cells.join(kept.select(probe), probe, "left_semi")


def pkd(value: Column) -> Column:
    """-log10 of a constant given in nanomoles."""
    return -F.log10(value * F.lit(1e-9))


def running_best(rows: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``iter`` (from 1) and ``best``, the least value so far, for each run."""
    span = Window.partitionBy(run).orderBy(*order)
    best = F.min(value).over(span.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("iter", F.row_number().over(span).cast("long")).withColumn("best", best)


def stall_lengths(series: DataFrame, run: str) -> DataFrame:
    """``run, stall, length, tail``: iterations without a better value between improvements, and the unfinished one."""
    span = Window.partitionBy(run).orderBy("iter")
    better = F.coalesce((F.col("best") < F.lag("best").over(span)).cast("int"), F.lit(1))
    marked = series.withColumn("_better", better)
    marked = marked.withColumn("stall", F.sum("_better").over(span.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy(run, "stall").agg((F.count(F.lit(1)) - 1).alias("length"))
    last = F.max("stall").over(Window.partitionBy(run))
    return found.withColumn("tail", F.col("stall") == last).where((F.col("length") > 0) | F.col("tail"))


def stalls_beyond(series: DataFrame, run: str, min_delta: float) -> DataFrame:
    """``run, stall, length, tail`` as ``stall_lengths`` without numbers of improvements, where only a fall of more than ``min_delta`` counts.

    Whether a value counts depends on the last one that did, so each run's history, as
    long as its iterations, is folded in order. ``stall`` counts from 0.
    """
    history = F.transform(F.array_sort(F.collect_list(F.struct("iter", F.col("best").cast("double").alias("best")))), lambda s: s.best)
    start = F.struct(F.lit(float("inf")).alias("least"), F.lit(0).cast("long").alias("stalled"), F.array().cast("array<bigint>").alias("ended"))

    def fold(a: Column, value: Column) -> Column:
        better = value < a.least - F.lit(min_delta)
        ended = F.when(better & (a.stalled > 0), F.concat(a.ended, F.array(a.stalled))).otherwise(a.ended)
        return F.struct(
            F.when(better, value).otherwise(a.least).alias("least"), F.when(better, F.lit(0).cast("long")).otherwise(a.stalled + 1).alias("stalled"), ended.alias("ended")
        )

    found = series.groupBy(run).agg(history.alias("_h")).select(run, F.aggregate("_h", start, fold).alias("_f"))
    lengths = F.concat("_f.ended", F.array("_f.stalled"))
    rows = found.select(run, F.size("_f.ended").alias("_last"), F.posexplode(lengths).alias("stall", "length"))
    return rows.select(run, F.col("stall").cast("long").alias("stall"), "length", (F.col("stall") == F.col("_last")).alias("tail"))
