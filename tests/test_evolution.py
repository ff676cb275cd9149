"""Search with several objectives: generations, the archive and the front that is found."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.operators import evolution, objectives, pareto
from evoframe.operators.budget import Budget
from evoframe.operators.search import initial


def two(x):
    return F.array(objectives.zdt1(x).f1, objectives.zdt1(x).f2)


def start(spark, runs: int, size: int, dim: int):
    return initial(spark, runs, size, dim, 0.0, 1.0, objectives.sphere).select("run", "id", "x")


def distance(rows) -> float:
    """Mean gap to the true front, f2 = 1 - sqrt(f1)."""
    return float(np.mean([r.f[1] - (1 - np.sqrt(r.f[0])) for r in rows]))


def test_the_front_comes_near_the_true_one(spark):
    first = start(spark, 2, 24, 4)
    found = evolution.evolve(first, two, 2, 0.0, 1.0, Budget(max_evals=24 * 7 + 5), archive_size=30).collect()
    before = evolution.front_of(first.withColumn("f", two(F.col("x"))), 2).collect()
    for run in (0, 1):
        own, old = ([r for r in rows if r.run == run] for rows in (found, before))
        assert distance(own) < 0.6 * distance(old) and 5 < len(own) < 60
        values = np.array([r.f for r in own])
        beats = (values[:, None] <= values[None]).all(axis=2) & (values[:, None] < values[None]).any(axis=2)
        assert not beats.any() and len({tuple(v) for v in values.tolist()}) == len(own)
        assert all(0 <= v <= 1 for r in own for v in r.x)


def test_elitism_and_ids(spark):
    population = start(spark, 3, 10, 3).withColumn("f", two(F.col("x")))
    assert sorted(evolution.generation(population, 2, 1, 0.5, 0.0, 1.0, two).collect()) == sorted(evolution.generation(population.repartition(7), 2, 1, 0.5, 0.0, 1.0, two).collect())
    after = evolution.generation(population, 2, 1, 0.0, 0.0, 1.0, two, mutation_rate=0.0, crossover_rate=0.0)
    rows = after.collect()
    assert {r.run for r in rows} == {0, 1, 2} and len(rows) == 30 and len({(r.run, r.id) for r in rows}) == 30
    known = {(r.run, tuple(r.x)) for r in population.collect()}
    assert {(r.run, tuple(r.x)) for r in rows} <= known  # children without crossover and mutation are copies
    best = {(r.run, r.id) for r in pareto.front_numbers(population.select("run", "id", F.col("f")[0].alias("a"), F.col("f")[1].alias("b")), ["a", "b"], "id", "run").where("front = 0").collect()}
    kept = {(r.run, tuple(r.f)) for r in rows}
    fits = {(r.run, r.id): tuple(r.f) for r in population.collect()}
    small = [k for k in best if sum(1 for b in best if b[0] == k[0]) * 2 <= 10]
    assert all((k[0], fits[k]) in kept for k in small)
    for wrong in ({"crossover_rate": 1.5}, {"mutation_rate": -1.0}, {"mutation_scale": 0.0}, {"blend_alpha": -0.1}):
        with pytest.raises(ValueError):
            evolution.generation(population, 2, 1, 0.0, 0.0, 1.0, two, **wrong)


def test_archive_is_pruned_at_twice_its_size(spark):
    draw = np.random.default_rng(4)
    line = [(1, i, [float(i)], [i / 20, 1 - i / 20]) for i in range(15)] + [(1, 100 + i, [0.0], [2.0 + v, 2.0]) for i, v in enumerate(draw.random(5).tolist())]
    few = [(2, i, [0.0], [float(i), float(i)]) for i in range(19)]
    archive = spark.createDataFrame(line + few, "run long, id long, x array<double>, f array<double>")
    found = evolution.pruned(archive, 2, 10).collect()
    assert sum(r.run == 2 for r in found) == 19
    own = [r for r in found if r.run == 1]
    assert len(own) == 10 and {0, 14} <= {r.id for r in own} and all(r.id < 100 for r in own)
    assert [tuple(r)[:2] for r in evolution.front_of(archive.where("run = 2"), 2).collect()] == [(2, 0)]
    with pytest.raises(ValueError):
        evolution.pruned(archive, 2, 1)


def test_budget_of_one_batch(spark):
    first = start(spark, 1, 8, 3)
    found = evolution.evolve(first, two, 2, 0.0, 1.0, Budget(max_evals=3)).collect()
    ids = {r.id for r in first.orderBy("id").limit(3).collect()}
    assert found and {r.id for r in found} <= ids
    assert evolution.evolve(first.limit(0), two, 2, 0.0, 1.0, Budget(max_iters=2)).count() == 0
    with pytest.raises(ValueError):
        evolution.evolve(first.unionByName(first.where("id < 2").withColumn("run", F.lit(9).cast("long"))), two, 2, 0.0, 1.0, Budget(max_iters=2))
