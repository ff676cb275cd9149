"""Steps of moving swarms: populations ``run, id, x, f`` that carry velocities and memories as further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.operators.objectives import clipped
from evoframe.operators.search import Objective, uniform


def _at_rest(population: DataFrame) -> DataFrame:
    """``population`` with velocities ``v``, 0 where it has none yet."""
    return population if "v" in population.columns else population.withColumn("v", F.transform("x", lambda _: F.lit(0.0)))


def _bounded(v: Column, most: float) -> Column:
    return F.least(F.greatest(v, F.lit(-most)), F.lit(most))


def _moved(population: DataFrame, low: float, high: float, objective: Objective) -> DataFrame:
    """Everyone moved by its velocity, inside the box, with its new fitness."""
    placed = population.withColumn("x", clipped(F.zip_with("x", "v", lambda x, v: x + v), low, high))
    return placed.withColumn("f", objective(F.col("x")))


def particle_swarm_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    w_start: float = 0.7, w_end: float = 0.4, own_pull: float = 2.0, best_pull: float = 2.0, max_velocity: float = 0.2,
) -> DataFrame:
    """Everyone is drawn to its own best place (``own``, ``own_f``) and to its run's, with falling inertia and bounded velocity."""
    population = _at_rest(population)
    if "own" not in population.columns:
        population = population.withColumns({"own": F.col("x"), "own_f": F.col("f")})
    lead = population.groupBy("run").agg(F.min_by("own", F.struct("own_f", "id")).alias("lead"))
    inertia = w_start - (w_start - w_end) * progress

    def velocity(v: Column, j: Column) -> Column:
        r1, r2 = (uniform(seed, iteration, F.col("run"), F.col("id"), j, k) for k in range(2))
        x = F.get("x", j)
        return _bounded(inertia * v + own_pull * r1 * (F.get("own", j) - x) + best_pull * r2 * (F.get("lead", j) - x), max_velocity * (high - low))

    drawn = population.join(lead, "run").withColumn("v", F.transform("v", velocity))
    moved = _moved(drawn, low, high, objective)
    better = F.col("f") < F.col("own_f")
    moved = moved.withColumn("own", F.when(better, F.col("x")).otherwise(F.col("own")))
    return moved.select("run", "id", "x", "f", "v", "own", F.least("own_f", "f").alias("own_f"))


def gravitation_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    gravity: float = 100.0, fall: float = 30.0, last: int = 1, max_velocity: float = 0.5,
) -> DataFrame:
    """Everyone is drawn to the heaviest of its run, fewer of them with time; mass is the lead over the run's worst.

    A run's population is a bounded group, so it joins as one array, the best first.
    """
    population = _at_rest(population)
    swarm = population.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("f", "id", "x"))).alias("swarm"))
    worst, best = F.element_at("swarm", -1).f, F.element_at("swarm", 1).f
    mass = F.transform("swarm", lambda s: F.when(worst > best, (worst - s.f) / F.when(worst > best, worst - best)).otherwise(F.lit(1.0)))
    total = F.aggregate("mass", F.lit(0.0), lambda t, m: t + m)
    size = F.size("swarm")
    heaviest = F.greatest(F.lit(last), F.round(size - progress * (size - last)).cast("int"))
    swarm = swarm.withColumn("mass", mass).withColumn("mass", F.transform("mass", lambda m: m / total))
    heavy = F.slice(F.zip_with("swarm", "mass", lambda s, m: F.struct(s.id.alias("id"), s.x.alias("x"), m.alias("m"))), F.lit(1), heaviest)
    joined = population.join(swarm.select("run", heavy.alias("heavy")), "run")

    def pull(h: Column) -> Column:
        gaps = F.zip_with(h.x, "x", lambda a, b: ((a - b) / (high - low)) * ((a - b) / (high - low)))
        apart = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda t, v: t + v))
        drawn = uniform(seed, iteration, F.col("run"), F.col("id"), h.id, "pull") * h.m / (apart + 1e-12)
        return F.when(h.id == F.col("id"), F.lit(0.0)).otherwise(drawn)

    joined = joined.withColumn("pull", F.transform("heavy", pull))
    constant = gravity * F.exp(F.lit(-fall * progress))
    kept = uniform(seed, iteration, F.col("run"), F.col("id"), "inertia")

    # added up vector by vector, so that each pull is drawn once and not again for every coordinate
    forces = F.aggregate(
        F.zip_with("heavy", "pull", lambda h, p: F.struct(h.x.alias("x"), p.alias("p"))), F.transform("x", lambda _: F.lit(0.0)),
        lambda a, h: F.zip_with(a, F.zip_with(h.x, "x", lambda to, at: h.p * (to - at)), lambda s, t: s + t),
    )
    velocity = F.zip_with("v", forces, lambda v, f: _bounded(kept * v + constant * f, max_velocity * (high - low)))

    moved = _moved(joined.withColumn("v", velocity), low, high, objective)
    return moved.select("run", "id", "x", "f", "v")
