"""Search over subsets by pheromones: the state of a run is a number for each coordinate and bit, not a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.operators.search import Objective, uniform


def fresh(runs: DataFrame, dimension: int) -> DataFrame:
    """``run, tau0, tau1``: even pheromones for each run."""
    even = F.array_repeat(F.lit(0.5), dimension)
    return runs.select("run").distinct().select("run", even.alias("tau0"), even.alias("tau1"))


def ants(pheromones: DataFrame, n: int, iteration: int = 0, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``run, id, x``: ``n`` strings of bits for each run, a bit set with its share of the pheromone; one that is empty gets one bit."""
    rows = pheromones.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def bit(t0: Column, t1: Column) -> Column:
        return F.pow(t1, F.lit(alpha)) / (F.pow(t0, F.lit(alpha)) + F.pow(t1, F.lit(alpha)))

    chance = F.zip_with("tau0", "tau1", bit)
    bits = F.transform(chance, lambda p, j: (uniform(seed, iteration, F.col("run"), F.col("id"), j) < p).cast("double"))
    rows = rows.withColumn("x", bits)
    one = F.floor(uniform(seed, iteration, F.col("run"), F.col("id"), "bit") * F.size("x")).cast("int")
    mended = F.transform("x", lambda _, j: (j == one).cast("double"))
    return rows.select("run", "id", F.when(F.exists("x", lambda b: b > 0), F.col("x")).otherwise(mended).alias("x"))


def laid(pheromones: DataFrame, best: DataFrame, evaporation: float = 0.1, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Pheromones a step nearer to the bits of each run's best string ``run, x``, inside the limits."""
    if not 0 < evaporation < 1 or not 0 < low < high:
        raise ValueError("evaporation is between 0 and 1, and 0 < low < high")

    def nearer(tau: Column, wanted: Column) -> Column:
        moved = (1.0 - evaporation) * tau + evaporation * wanted
        return F.least(F.greatest(moved, F.lit(low)), F.lit(high))

    joined = pheromones.join(best.select("run", F.col("x").alias("_x")), "run")
    return joined.select("run", F.zip_with("tau0", "_x", lambda t, b: nearer(t, 1.0 - b)).alias("tau0"), F.zip_with("tau1", "_x", lambda t, b: nearer(t, b)).alias("tau1"))


def step(
    pheromones: DataFrame, best: DataFrame | None, objective: Objective, n: int = 30, iteration: int = 0, evaporation: float = 0.1, alpha: float = 1.0, low: float = 0.1, high: float = 0.9, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The pheromones and the best strings ``run, id, x, f`` after ``n`` further ants in each run; an older one stays, if it is not worse."""
    made = ants(pheromones, n, iteration, alpha, seed).withColumn("f", objective(F.col("x")))
    if best is not None:
        made = made.unionByName(best.select("run", F.lit(-1).cast("long").alias("id"), "x", "f"))
    lead = made.groupBy("run").agg(F.min_by(F.struct("id", "x", "f"), F.struct("f", "id")).alias("b")).select("run", "b.*")
    return laid(pheromones, lead, evaporation, low, high), lead
