"""Normalization of wide numeric matrices in long form: ``sample_id, probe_id, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("sample_id", "probe_id")


def log2_transform(cells: DataFrame, offset: float = 1.0) -> DataFrame:
    """log2(value + offset); a cell that has none raises an error, a missing one stays missing."""
    shifted = F.col("value") + F.lit(offset)
    sound = F.assert_true(F.coalesce(shifted > 0, F.lit(True)), F.lit("values must be above -offset")).isNull()
    return cells.withColumn("value", F.when(sound, F.log2(shifted)))


def zscore(cells: DataFrame) -> DataFrame:
    """Each probe to mean 0 and population deviation 1; constant probes to 0."""
    by = cells.groupBy("probe_id").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return cells.join(by, "probe_id").withColumn("value", (F.col("value") - F.col("_mean")) / sd).select(*KEYS, "value")


def median_center(cells: DataFrame) -> DataFrame:
    """Each sample less its median."""
    by = cells.groupBy("sample_id").agg(F.median("value").alias("_mid"))
    return cells.join(by, "sample_id").withColumn("value", F.col("value") - F.col("_mid")).select(*KEYS, "value")


def quantile_normalize(cells: DataFrame) -> DataFrame:
    """All samples to one distribution: the mean over samples of each rank; ties share the mean of their ranks' neighbours."""
    sound = F.assert_true(F.col("value").isNotNull(), F.lit("missing values")).isNull()
    cells = cells.withColumn("value", F.when(sound, F.col("value")))
    own = Window.partitionBy("sample_id").orderBy("value")
    ranked = cells.withColumn("_rn", F.row_number().over(own.orderBy("value", "probe_id")))
    means = ranked.groupBy("_rn").agg(F.avg("value").alias("_level"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("sample_id", "value"))
    ranked = ranked.withColumn("_rank", F.rank().over(own) + (ties - 1) / F.lit(2.0))
    low = means.select(F.col("_rn").alias("_low"), F.col("_level").alias("_a"))
    high = means.select(F.col("_rn").alias("_high"), F.col("_level").alias("_b"))
    found = ranked.withColumn("_low", F.floor("_rank").cast("int")).withColumn("_high", F.ceil("_rank").cast("int"))
    return found.join(low, "_low").join(high, "_high").select(*KEYS, ((F.col("_a") + F.col("_b")) / 2).alias("value"))


def top_variance(cells: DataFrame, k: int) -> DataFrame:
    """``probe_id, variance`` of the k probes of largest sample variance, ties by id."""
    if k < 1:
        raise ValueError("k is 1 at least")
    return cells.groupBy("probe_id").agg(F.var_samp("value").alias("variance")).orderBy(F.desc_nulls_last("variance"), "probe_id").limit(k)
