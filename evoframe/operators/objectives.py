"""Objectives that score whole batches of candidates in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions import metrics
from evoframe.functions.hashing import hash_order


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def sphere(x: Column) -> Column:
    return _total(F.transform(x, lambda v: v * v))


def rastrigin(x: Column) -> Column:
    return 10.0 * F.size(x) + _total(F.transform(x, lambda v: v * v - 10.0 * F.cos(2 * math.pi * v)))


def ackley(x: Column) -> Column:
    waves = _total(F.transform(x, lambda v: F.cos(2 * math.pi * v)))
    return -20.0 * F.exp(-0.2 * F.sqrt(sphere(x) / F.size(x))) - F.exp(waves / F.size(x)) + 20.0 + math.e


def clipped(x: Column, low: float, high: float) -> Column:
    """Every coordinate moved into the box."""
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def weights(x: Column) -> Column:
    """Negative weights to 0, then to sum 1; uniform where nothing is left."""
    positive = F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))
    total = _total(positive)
    sound = (total > 0) & ~F.isnan(total) & (total < float("inf"))
    return F.when(sound, F.transform(positive, lambda v: v / F.when(sound, total))).otherwise(F.transform(x, lambda v: 1.0 / F.size(x)))


def ensemble_scores(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every row with every candidate of a batch: ``cand_id, score`` beside the columns of ``rows``.

    ``rows`` have ``p``, one probability for each member. Candidates meet the rows in blocks of
    bounded size.
    """
    from evoframe.operators.models import with_each

    unrolled = with_each(rows, candidates.select("cand_id", weights(F.col("x")).alias("w")))
    return unrolled.withColumn("score", _total(F.zip_with("p", "w", lambda a, b: a * b))).drop("w")


def ensemble_errors(rows: DataFrame, candidates: DataFrame, threshold: float = 0.5, metric: str = "accuracy") -> DataFrame:
    """``cand_id, fitness``: 1 - the metric (accuracy, f1 or auc) of the weighted vote, for a batch of candidates.

    The rows are read once and aggregated before the shuffle, whatever the number of candidates.
    """
    scored = ensemble_scores(rows, candidates)
    if metric == "auc":
        return metrics.auc(scored, "y", "score", ("cand_id",)).select("cand_id", (1 - F.col("auc")).alias("fitness"))
    if metric not in ("accuracy", "f1"):
        raise ValueError("the metric is accuracy, f1 or auc")
    voted = scored.withColumn("_voted", (F.col("score") > threshold).cast("int"))
    return voted.groupBy("cand_id").agg((1 - getattr(metrics, metric)("y", "_voted")).alias("fitness"))


def undersample_repair(bits: DataFrame, keep: int, seed: int = 0) -> DataFrame:
    """Rows ``cand_id, row_id, bit`` that a candidate keeps: exactly ``keep`` (all, if fewer), those with larger bits first, ties by hash.

    ``keep`` is ``kept_majority(...)``. A histogram of (bit, first 12 bits of the hash) for
    each candidate shows where its last row lies, so only the rows of one bin are ranked.
    """
    head = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    marked = bits.withColumn("_hash", hash_order(seed, "cand_id", "row_id")).withColumn("_bin", F.struct((-F.col("bit").cast("double")).alias("b"), head.alias("h")))
    counts = marked.groupBy("cand_id", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("cand_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.withColumn("_before", before).where(F.col("_before") < keep).withColumn("_whole", F.col("_before") + F.col("_n") <= keep)
    placed = marked.join(bins.select("cand_id", "_bin", "_before", "_whole"), ["cand_id", "_bin"])
    order = Window.partitionBy("cand_id", "_bin").orderBy("_hash", "row_id")
    border = placed.where("NOT _whole").withColumn("_nth", F.row_number().over(order)).where(F.col("_before") + F.col("_nth") <= keep)
    return placed.where("_whole").select(*bits.columns).unionByName(border.select(*bits.columns))


def kept_majority(n_minority: int, n_majority: int, target_ratio: float = 1.0) -> int:
    """How many rows of the majority class stay."""
    if target_ratio <= 0:
        raise ValueError("the ratio is above 0")
    return max(1, min(round(target_ratio * n_minority), n_majority))


def weighted_centroid(rows: DataFrame, x: str, weight: str, by: str) -> DataFrame:
    """``by, centroid``: the mean position of each group, by weight; null where the weights add up to 0."""
    parts = rows.select(by, F.col(weight).cast("double").alias("_w"), F.posexplode(x).alias("_j", "_v"))
    sums = parts.groupBy(by, "_j").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"))
    mean = F.col("_s") / F.when(F.col("_t") != 0, F.col("_t"))
    return sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", mean.alias("_m")))), lambda s: s._m).alias("centroid"))


def selected(x: Column, threshold: float = 0.5) -> Column:
    """Indexes, from 0, of the features whose value is above the threshold."""
    marked = F.transform(x, lambda v, i: F.when(v > threshold, i))
    return F.filter(marked, lambda i: i.isNotNull())


def zdt1(x: Column) -> Column:
    """The two-objective test function ZDT1 as ``f1, f2``."""
    first = F.get(x, F.lit(0))
    g = 1.0 + 9.0 * _total(F.slice(x, 2, F.size(x))) / (F.size(x) - 1)
    return F.struct(first.alias("f1"), (g * (1.0 - F.sqrt(first / g))).alias("f2"))


def levy_step(u: Column, v: Column, beta: float = 1.5, scale: float = 1.0) -> Column:
    """A heavy-tailed step from two standard normal numbers; null where ``v`` is 0."""
    spread = math.gamma(1 + beta) * math.sin(math.pi * beta / 2) / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))
    return scale * spread ** (1 / beta) * u / F.pow(F.abs(F.when(v != 0, v)), F.lit(1 / beta))


def accepted(f: Column, new: Column, temperature: Column, u: Column) -> Column:
    """Whether a proposal is taken: always if it is better, else with a chance that falls with its loss; never if it is not finite."""
    loss = new - f
    finite = ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    return ((new < f) & ~F.isnan(new)) | (finite & (u < F.exp(-loss / temperature)))
