"""Every step of a search, over several generations: inside the box, better than the start, and the same at any partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evoframe.operators import flight, objectives, search, swarm

STEPS = search.STEPS | flight.STEPS | {"particle_swarm": swarm.particle_swarm_step, "gravitation": swarm.gravitation_step}


def few(spark):
    return search.initial(spark, 2, 12, 3, -5.0, 5.0, objectives.sphere, 4)


@pytest.mark.parametrize("name", sorted(STEPS))
def test_steps_go_on_from_their_own_columns(spark, name):
    population = start = few(spark)
    for iteration in range(1, 5):
        moved = STEPS[name](population, iteration, iteration / 5, -5.0, 5.0, objectives.sphere)
        population = spark.createDataFrame(moved.collect(), moved.schema).repartition(1 + iteration % 3, "id")
    rows, first = population.collect(), start.collect()
    assert sorted((r.run, r.id) for r in rows) == sorted((r.run, r.id) for r in first)
    assert all(-5.0 <= v <= 5.0 for r in rows for v in r.x) and all(r.f == pytest.approx(sum(v * v for v in r.x)) for r in rows)
    for run in (0, 1):
        least = [min([r.f for r in some if r.run == run] + [r.flame_f for r in some if r.run == run and "flame_f" in r]) for some in (rows, first)]
        assert least[0] < least[1] * (3 if name == "gravitation" else 1.0000001)


@pytest.mark.parametrize("name", ["moth_flame", "bat", "ant_archive", "firefly"])
def test_steps_are_the_same_at_any_partitioning(spark, name):
    one, two = (STEPS[name](few(spark).repartition(n), 3, 0.5, -5.0, 5.0, objectives.sphere).select("run", "id", "x") for n in (1, 5))
    rows = one.join(two.withColumnRenamed("x", "y"), ["run", "id"])
    assert rows.count() == 24 and rows.where(F.exists(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)).count() == 0


def test_differential_moves_positions_once(spark):
    population = spark.createDataFrame(few(spark).collect())
    plan = search.differential_step(population, 3, 0.5, -5.0, 5.0, objectives.sphere)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
