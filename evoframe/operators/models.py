"""Models fitted and judged for whole batches of candidates: undersampled training sets, and members of fitted ensembles."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions import metrics
from evoframe.operators.objectives import kept_majority, undersample_repair

#: Candidates that one row of work holds.
BLOCK = 64
#: Part of the largest variance that is added to all, so that none is 0.
SMOOTHING = 1e-9


def with_each(rows: DataFrame, batch: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row with every row of a batch, by one equality join over blocks of the batch.

    Blocks are copied to as many salts as there are shuffle partitions and the rows dealt
    to them, so neither side is one task's; Spark sends a small batch to all tasks instead.
    """
    blocks = max(1, -(-batch.count() // block))
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    names = [F.col(f"`{c}`") for c in batch.columns]
    packed = batch.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks))).groupBy("_block").agg(F.collect_list(F.struct(*names)).alias("_batch"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.join(packed, ["_block", "_salt"]).select(*[F.col(f"`{c}`") for c in rows.columns], F.inline("_batch"))


def _moments(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """``n, s, q``: rows, sums and sums of squares of each feature, added up before the shuffle."""
    x = [F.get("x", F.lit(j)) for j in range(width)]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(v * v) for v in x]).alias("q"))
    return found


def gaussian_models(train: DataFrame, kept: DataFrame, minority: int, width: int) -> DataFrame:
    """``cand_id, model``: for each candidate's training set a Gaussian naive Bayes model, an array of ``label, prior, mean, var``.

    ``kept`` has the rows of the majority that each candidate keeps, ``cand_id, row_id``; all
    rows of the minority belong to every set, so their sums are made once. No row reaches Python.
    """
    rare = _moments(train.where(F.col("y") == minority), ["y"], width)
    often = _moments(kept.join(train, F.col("row_id") == F.col("id")), ["cand_id", "y"], width)
    every = often.select("cand_id").distinct()
    rare = every.withColumn("y", F.lit(minority)).join(rare.withColumn("y", F.lit(minority)), "y")  # one row for each candidate
    both = often.unionByName(rare.select(*often.columns))
    sets = both.groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("long").alias("label"), "n", "s", "q"))).alias("parts"))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.n)
    features = F.sequence(F.lit(0), F.lit(width - 1))

    def total(name: str, j: Column) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.get(p[name], j))

    whole = F.transform(features, lambda j: total("q", j) / F.col("n") - F.pow(total("s", j) / F.col("n"), F.lit(2)))
    sets = sets.withColumn("n", n).withColumn("least", F.array_max(whole) * SMOOTHING)

    def part(p: Column) -> Column:
        mean = F.transform(p.s, lambda s: s / p.n)
        var = F.transform(features, lambda j: F.greatest(F.get(p.q, j) / p.n - F.pow(F.get(p.s, j) / p.n, F.lit(2)), F.lit(0.0)) + F.col("least"))
        return F.struct(p.label.alias("label"), F.log(p.n / F.col("n")).alias("prior"), mean.alias("mean"), var.alias("var"))

    return sets.select("cand_id", F.transform("parts", part).alias("model"))


def predicted(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` ``..., x`` with ``cand_id`` and ``predicted``, the likelier label of each model; the smaller one, if they are alike."""

    def score(m: Column) -> Column:
        z = F.zip_with(F.zip_with("x", m["mean"], lambda v, mean: (v - mean) * (v - mean)), m["var"], lambda d, var: F.log(2 * math.pi * var) + d / var)
        return F.struct((m["prior"] - 0.5 * F.aggregate(z, F.lit(0.0), lambda a, v: a + v)).alias("score"), (-m["label"]).alias("label"))

    judged = with_each(rows, models)
    return judged.withColumn("predicted", -F.array_max(F.transform("model", score)).label).drop("model")


def undersampling_fitness(train: DataFrame, valid: DataFrame, bits: DataFrame, metric: str = "f1", target_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """``cand_id, fitness``: 1 - the metric on ``valid`` of a Gaussian naive Bayes model fitted on each candidate's undersampled set.

    ``train`` and ``valid`` are ``id, y, x``; ``bits`` ``cand_id, row_id, bit`` says which rows of
    the majority a candidate wants, repaired to exactly the number that the ratio asks for.
    The metric is f1 of the minority, accuracy or balanced_accuracy.
    """
    if metric not in ("f1", "accuracy", "balanced_accuracy"):
        raise ValueError("the metric is f1, accuracy or balanced_accuracy")
    sizes = sorted((r.n, r.y) for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(3).collect())
    if len(sizes) != 2:
        raise ValueError("undersampling needs exactly two classes")
    (few, minority), (many, _) = sizes
    width = train.select(F.size("x")).first()[0]
    kept = undersample_repair(bits, kept_majority(few, many, target_ratio), seed).select("cand_id", "row_id")
    judged = predicted(valid.select("y", "x"), gaussian_models(train, kept, minority, width))
    is_rare = lambda c: (F.col(c) == minority).cast("int")
    judged = judged.select("cand_id", is_rare("y").alias("y"), is_rare("predicted").alias("predicted"))
    return judged.groupBy("cand_id").agg((1 - getattr(metrics, metric)("y", "predicted")).alias("fitness"))


def member_probabilities(ensemble, rows: DataFrame, features: str = "features") -> DataFrame:
    """``rows`` with ``p``: the probability of the positive class by each member of a fitted ensemble, in one pass.

    An ensemble has ``trees``, or is a list of fitted binary classifiers of ``pyspark.ml``.
    """
    members = list(getattr(ensemble, "trees", ensemble))
    if not members:
        raise ValueError("an ensemble without members")
    found = rows
    for k, member in enumerate(members):
        one = member.copy({member.featuresCol: features, member.probabilityCol: f"_p{k}", member.rawPredictionCol: "", member.predictionCol: ""})
        found = one.transform(found)
    p = F.array(*[F.get(vector_to_array(f"_p{k}"), F.lit(1)) for k in range(len(members))])
    return found.withColumn("p", p).drop(*[f"_p{k}" for k in range(len(members))])
