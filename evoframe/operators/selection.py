"""What survives, mates or leads: selections within populations ``run, id, f``.

Populations are groups of bounded size; runs never meet, so they spread over all tasks.
Random numbers come as columns of the draws, so a selection is the same at any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.operators.pareto import crowding_distance, pareto_order
from evoframe.operators.search import uniform


def worst(population: DataFrame, k: int) -> DataFrame:
    """The ``k`` worst of each run with ``place`` from the worst on; of equal ones the larger id comes first."""
    order = Window.partitionBy("run").orderBy(F.desc("f"), F.desc("id"))
    return population.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def survivors(points: DataFrame, objectives: list[str], key: str, run: str, n: int, large: bool = False) -> DataFrame:
    """The next generation of size ``n``: whole fronts in turn, the last one cut by crowding; ``large`` as in ``pareto_order``."""
    return pareto_order(points, objectives, key, run, large).where(F.col("place") <= n)


def capped(archive: DataFrame, objectives: list[str], key: str, run: str, n: int) -> DataFrame:
    """The ``n`` most isolated points of each run's archive, with ``place`` in the order of the key, which stays."""
    found = crowding_distance(archive, objectives, key, run)
    isolated, kept = Window.partitionBy(run).orderBy(F.desc("crowding"), key), Window.partitionBy(run).orderBy(key)
    found = found.withColumn("place", F.row_number().over(isolated)).where(F.col("place") <= n)
    return found.withColumn("place", F.row_number().over(kept))


def rank_weights(population: DataFrame, intensification: float = 0.1) -> DataFrame:
    """``population`` with ``weight``: a Gaussian of the rank, of sum 1 in each run; the smaller its width, the more the best weigh."""
    run = Window.partitionBy("run")
    ranked = population.withColumn("weight", F.row_number().over(run.orderBy("f", "id")) - 1)
    width = intensification * F.count(F.lit(1)).over(run)
    ranked = ranked.withColumn("weight", F.exp(-F.pow(F.col("weight") / width, 2) / 2.0))
    return ranked.withColumn("weight", F.col("weight") / F.sum("weight").over(run))


def roulette(population: DataFrame, draws: DataFrame) -> DataFrame:
    """``run, draw, id``: for each draw ``run, draw, u`` the individual whose share of the wheel holds ``u`` in [0, 1).

    Shares follow ``weight`` and lie in the order of ids; equal shares where no weight of a run is positive.
    """
    run = Window.partitionBy("run")
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    shares = population.withColumn("weight", weight).withColumn("total", F.sum("weight").over(run))
    shares = shares.withColumn("weight", F.when(F.col("total") > 0, F.col("weight")).otherwise(F.lit(1.0)))
    ends = shares.withColumn("end", F.sum("weight").over(run.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    wheel = ends.where(F.col("weight") > 0).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("end", "id"))).alias("wheel"))
    place = F.col("u") * F.element_at("wheel", -1).end
    hit = F.get(F.filter("wheel", lambda s: s.end > place), F.lit(0))
    return draws.join(wheel, "run").select("run", "draw", F.coalesce(hit, F.element_at("wheel", -1)).id.alias("id"))


def entrants(population: DataFrame, tournaments: int, size: int = 2, seed: int = 0, iteration: int = 0) -> DataFrame:
    """``run, tournament, id``: ``size`` individuals for each tournament, drawn with repetition."""
    ids = population.groupBy("run").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    places = F.explode(F.sequence(F.lit(0), F.lit(tournaments * size - 1)))
    drawn = ids.select("run", "ids", places.alias("at"))
    id_ = F.get("ids", F.floor(uniform(seed, iteration, F.col("run"), F.col("at"), "tournament") * F.size("ids")).cast("int"))
    return drawn.select("run", F.floor(F.col("at") / size).cast("long").alias("tournament"), id_.alias("id"))


def winners(population: DataFrame, entered: DataFrame) -> DataFrame:
    """``run, tournament, id``: the best of each tournament, ties to the smaller id."""
    met = entered.join(population.select("run", "id", "f"), ["run", "id"])
    return met.groupBy("run", "tournament").agg(F.min_by("id", F.struct("f", "id")).alias("id"))


def distances(population: DataFrame) -> DataFrame:
    """``population`` with ``others``: an array of ``d, id``, the distance to everyone else of the run, the nearest first."""
    swarm = population.groupBy("run").agg(F.collect_list(F.struct("id", "x")).alias("swarm"))

    def apart(s: Column) -> Column:
        squares = F.zip_with(s.x, "x", lambda a, b: (a - b) * (a - b))
        return F.struct(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v)).alias("d"), s.id.alias("id"))

    others = F.array_sort(F.transform(F.filter("swarm", lambda s: s.id != F.col("id")), apart))
    return population.join(swarm, "run").withColumn("others", others).drop("swarm")


def neighbours(population: DataFrame, part: float = 0.2) -> DataFrame:
    """``population`` with ``radius``, ``part`` of the mean distance to the run's members (itself at 0 among them), and ``near``, the ids within it."""
    found = distances(population)
    total = F.aggregate("others", F.lit(0.0), lambda t, o: t + o.d)
    found = found.withColumn("radius", part * total / (F.size("others") + 1))
    return found.withColumn("near", F.transform(F.filter("others", lambda o: o.d < F.col("radius")), lambda o: o.id))


def knees(front: DataFrame, f1: str, f2: str, key: str, run: str) -> DataFrame:
    """``run, key`` of the point of each front that is farthest from the chord between its ends, ``f1`` as a part of its maximum.

    Ties, to nine digits, go to the smaller ``f1``.
    """
    most = F.max(f1).over(Window.partitionBy(run))
    points = front.select(run, key, F.coalesce(F.col(f1) / F.when(most != 0, most), F.lit(0.0)).alias("u"), F.col(f2).alias("v"))
    order, place = F.struct("u", "v", key), F.struct("u", "v")
    chords = points.groupBy(run).agg(F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"))
    du, dv = F.col("b.u") - F.col("a.u"), F.col("b.v") - F.col("a.v")
    length = F.sqrt(du * du + dv * dv)
    off = F.abs(du * (F.col("v") - F.col("a.v")) - dv * (F.col("u") - F.col("a.u"))) / F.when(length > 0, length)
    rated = points.join(chords, run).withColumn("off", -F.coalesce(F.round(off, 9), F.lit(0.0)))
    return rated.groupBy(run).agg(F.min_by(key, F.struct("off", "u", "v", key)).alias(key))
