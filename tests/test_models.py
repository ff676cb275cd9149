"""Undersampled training sets, members of ensembles and pheromones against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from evoframe.operators import colony, models, objectives


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(21)
    y = (draw.random(260) < 0.25).astype(int)
    x = np.round(draw.normal(y[:, None] * 0.8, [1.0, 2.0, 0.5], (260, 3)), 3)
    x[:, 2] = np.where(y, 1.0, x[:, 2])  # no variance in one class
    rows = [(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, y int, x array<double>").repartition(3), y, x


def bayes(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    eps, scores = 1e-9 * x.var(axis=0).max(), []
    for c in (0, 1):
        mean, var = x[y == c].mean(axis=0), x[y == c].var(axis=0) + eps
        scores.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * var) + (new - mean) ** 2 / var).sum(axis=1))
    return (scores[1] > scores[0]).astype(int)


@pytest.mark.parametrize("metric", ["f1", "accuracy", "balanced_accuracy"])
def test_undersampled_models(spark, points, metric):
    rows, y, x = points
    train, valid = rows.where("id < 180"), rows.where("id >= 180")
    majority = [i for i in range(180) if not y[i]]
    bits = [(c, i, float((i * (c + 2)) % 5 < 3)) for c in range(70) for i in majority]  # more than a block of candidates
    batch = spark.createDataFrame(bits, "cand_id long, row_id long, bit double")
    found = {r.cand_id: r.fitness for r in models.undersampling_fitness(train, valid, batch, metric).collect()}
    keep = int(y[:180].sum())
    kept = objectives.undersample_repair(batch, keep, 0).groupBy("cand_id").agg(F.collect_list("row_id").alias("ids")).collect()
    assert len(found) == len(kept) == 70
    for r in kept:
        own = sorted(r.ids) + [i for i in range(180) if y[i]]
        guess, true = bayes(x[own], y[own], x[180:]), y[180:]
        tp, fp, fn, tn = (int(((guess == a) & (true == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
        want = {"f1": 2 * tp / (2 * tp + fp + fn), "accuracy": (tp + tn) / 80, "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2}[metric]
        assert len(r.ids) == keep and found[r.cand_id] == pytest.approx(1 - want)


def test_wrong_training_sets(spark, points):
    rows, bits = points[0], spark.createDataFrame([(0, 1, 1.0)], "cand_id long, row_id long, bit double")
    with pytest.raises(ValueError):
        models.undersampling_fitness(rows, rows, bits, "auc")
    for wrong in (rows.where("y = 1"), rows.withColumn("y", (F.col("id") % 3).cast("int"))):
        with pytest.raises(ValueError):
            models.undersampling_fitness(wrong, rows, bits)


def test_every_row_meets_every_candidate(spark):
    rows, batch = spark.range(50).withColumn("a", F.col("id") * 2), spark.range(9).toDF("k")
    for block in (2, 100):
        found = models.with_each(rows, batch, block)
        assert found.columns == ["id", "a", "k"]
        assert sorted(map(tuple, found.collect())) == [(i, 2 * i, k) for i in range(50) for k in range(9)]
    assert models.with_each(rows, batch.limit(0)).count() == 0


def test_members_of_ensembles(spark, points):
    rows = points[0].withColumn("inputs", array_to_vector("x"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="inputs", numTrees=7, maxDepth=3, seed=1).fit(rows)
    found = models.member_probabilities(forest, rows, "inputs")
    assert found.columns == [*rows.columns, "p"]
    whole = forest.transform(found).select("p", F.get(vector_to_array("probability"), F.lit(1)).alias("whole")).collect()
    assert all(len(r.p) == 7 and np.mean(r.p) == pytest.approx(r.whole) for r in whole)
    other = LogisticRegression(labelCol="y", featuresCol="inputs").fit(rows)
    mixed = models.member_probabilities([forest.trees[0], other], rows, "inputs")
    scored = objectives.ensemble_errors(mixed.select("id", "y", "p"), spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cand_id long, x array<double>"))
    alone = {k: m.transform(rows).where("prediction <> y").count() / 260 for k, m in enumerate((forest.trees[0], other))}
    assert {r.cand_id: pytest.approx(r.fitness) for r in scored.collect()} == alone
    with pytest.raises(ValueError):
        models.member_probabilities([], rows)


def test_ants_find_the_bits_wanted(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run long")
    wanted = [float(j % 3 == 0) for j in range(12)]
    objective = lambda x: F.aggregate(F.zip_with(x, F.array(*map(F.lit, wanted)), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    pheromones, best = colony.fresh(runs, 12), None
    for iteration in range(12):
        pheromones, best = (spark.createDataFrame(t.collect(), t.schema) for t in colony.step(pheromones, best, objective, 25, iteration, evaporation=0.3))
    assert [r.f for r in best.collect()] == [0.0, 0.0] and all(r.x == wanted for r in best.collect())
    for r in pheromones.collect():
        assert all(0.1 <= t <= 0.9 for t in r.tau0 + r.tau1)
        assert [float(t > 0.5) for t in r.tau1] == wanted
    empty = pheromones.withColumn("tau1", F.transform("tau1", lambda _: F.lit(0.0)))
    assert all(sum(r.x) == 1 for r in colony.ants(empty, 20).collect())
    with pytest.raises(ValueError):
        colony.laid(pheromones, best, evaporation=1.0)
