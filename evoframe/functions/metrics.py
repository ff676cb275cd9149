"""Classification metrics as aggregations, for one group or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.hashing import cuts_of, range_of, summed_within


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def accuracy(y: str, predicted: str) -> Column:
    return F.avg((F.col(y) == F.col(predicted)).cast("double"))


def f1(y: str, predicted: str, positive: int = 1) -> Column:
    true, said = F.col(y) == positive, F.col(predicted) == positive
    hits = 2 * F.count_if(true & said)
    return _ratio(hits, hits + F.count_if(true & ~said) + F.count_if(~true & said))


def recall(y: str, predicted: str, positive: int = 1) -> Column:
    true = F.col(y) == positive
    return _ratio(F.count_if(true & (F.col(predicted) == positive)), F.count_if(true))


def balanced_accuracy(y: str, predicted: str) -> Column:
    return (recall(y, predicted, 1) + recall(y, predicted, 0)) / 2


def auc(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``auc`` by average ranks, for each group of ``by``; 0.5 where one class is missing.

    Only counts for each distinct score are ranked, and those in ranges of the score, so
    no window holds all rows.
    """
    counts = rows.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_neg"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = counts.withColumn("_block", range_of(F.col(score), cuts_of(rows, score, parts)))
    ahead = (Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*by, "_block").agg(F.sum("_neg").alias("_sum"))  # one row for a range, and group
    below = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(*ahead)), F.lit(0))
    sums = sums.select(*by, "_block", below.alias("_below"))
    own = F.coalesce(F.sum("_neg").over(Window.partitionBy(*by, "_block").orderBy(score).rowsBetween(*ahead)), F.lit(0))
    ranked = blocks.withColumn("_own", own).join(sums, [*by, "_block"])
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_own") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_p").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(F.when(pairs == 0, F.lit(0.5)).otherwise(wins / F.when(pairs != 0, pairs)).alias("auc"))


def medians(rows: DataFrame, group: str, value: str, name: str = "median") -> DataFrame:
    """``group, name``: the exact median of each group's known values.

    Equal values are counted first, and the counts added up over ranges of the value, so a
    group of any size is spread over all tasks and none is held in one buffer.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = summed_within(counts, group, "_v", "_n", "_before")
    totals = counts.groupBy(F.col(group).alias("_group")).agg(F.sum("_n").alias("_total"))
    met = placed.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    holds = [(F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")) for at in (F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2))]
    middle = met.where(holds[0] | holds[1]).groupBy(group)
    return middle.agg(((F.max(F.when(holds[0], F.col("_v"))) + F.max(F.when(holds[1], F.col("_v")))) / 2).alias(name))
