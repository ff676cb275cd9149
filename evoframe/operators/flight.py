"""Steps of further searches, whole generations at once: populations ``run, id, x, f`` in which everyone sees the same run as it was.

State that a search carries is a column beside the position, so a step is called as those of
``search.STEPS`` are. A run is a group of bounded size and joins as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.operators.evolution import once
from evoframe.operators.objectives import accepted, clipped, levy_step
from evoframe.operators.search import Objective, uniform

_TURN = 6.283185307179586


def _draws(seed: int, iteration: int):
    """Uniform and standard normal numbers of one step, by names."""

    def drawn(*parts) -> Column:
        return uniform(seed, iteration, F.col("run"), F.col("id"), *parts)

    def normal(*parts) -> Column:
        return F.sqrt(-2.0 * F.log(1.0 - drawn(*parts, "radius"))) * F.cos(_TURN * drawn(*parts, "angle"))

    return drawn, normal


def _swarmed(population: DataFrame, *order: str) -> DataFrame:
    """``population`` with ``swarm``, its run's individuals in the order of the named columns, and ``best``, the position of least ``f``."""
    fields = [c for c in dict.fromkeys([*order, "f", "id", "x"])]
    swarm = population.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("swarm"), F.min_by("x", F.struct("f", "id")).alias("best"))
    return population.join(swarm, "run")


def _placed(rows: DataFrame, x: Column, low: float, high: float, objective: Objective) -> DataFrame:
    return rows.withColumn("_x", clipped(x, low, high)).withColumn("_f", objective(F.col("_x")))


def _moved(rows: DataFrame, x: Column, low: float, high: float, objective: Objective, *more: str) -> DataFrame:
    """Everyone at its new place."""
    return _placed(rows, x, low, high, objective).select("run", "id", F.col("_x").alias("x"), F.col("_f").alias("f"), *more)


def _greedy(rows: DataFrame, x: Column, low: float, high: float, objective: Objective) -> DataFrame:
    """Everyone at its new place, if that is better."""
    better = F.col("_f") < F.col("f")
    return _placed(rows, x, low, high, objective).select("run", "id", F.when(better, F.col("_x")).otherwise(F.col("x")).alias("x"), F.when(better, F.col("_f")).otherwise(F.col("f")).alias("f"))


def whale_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0, a_start: float = 2.0, spiral: float = 2.0
) -> DataFrame:
    """Everyone closes in on the best, or early on a random other, in a line or on a spiral around the best."""
    drawn, _ = _draws(seed, iteration)
    a = a_start * (1.0 - progress)
    rows = _swarmed(population, "id")
    far = F.abs(2.0 * a * drawn("reach") - a) >= 1.0
    peer = F.get("swarm", F.floor(drawn("peer") * F.size("swarm")).cast("int")).x
    rows = rows.withColumns({"to": F.when(far, peer).otherwise(F.col("best")), "straight": drawn("line") < 0.5})

    def gene(v: Column, j: Column) -> Column:
        to, lead, turn = F.get("to", j), F.get("best", j), 2.0 * drawn(j, 2) - 1.0
        line = to - (2.0 * a * drawn(j, 0) - a) * F.abs(2.0 * drawn(j, 1) * to - v)
        return F.when(F.col("straight"), line).otherwise(F.abs(lead - v) * F.exp(spiral * turn) * F.cos(_TURN * turn) + lead)

    return _moved(rows, F.transform("x", gene), low, high, objective)


def moth_flame_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    spiral: float = 1.0, a_start: float = -1.0, a_end: float = -2.0,
) -> DataFrame:
    """Each moth circles a flame, one of the best places that its run has known; flames grow fewer.

    ``flame, flame_f`` are a run's flames, as many as moths, one beside each moth in no order.
    """
    drawn, _ = _draws(seed, iteration)
    pool = population.select("run", "f", F.lit(1).alias("kind"), "id", "x")
    if "flame" in population.columns:
        pool = pool.unionByName(population.select("run", F.col("flame_f").alias("f"), F.lit(0).alias("kind"), "id", F.col("flame").alias("x")))
    flames = pool.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("f", "kind", "id", "x"))).alias("flames"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("run"))
    rows = population.select("run", "id", "x", nth.alias("nth"), size.alias("size")).join(flames, "run")
    lit = F.greatest(F.lit(1), F.bround(F.col("size") - progress * (F.col("size") - 1)).cast("int"))
    rows = rows.withColumns({"near": F.get("flames", F.least(F.col("nth"), lit - 1)).x, "flame": F.get("flames", F.col("nth")).x, "flame_f": F.get("flames", F.col("nth")).f})
    a = a_start + (a_end - a_start) * progress

    def gene(v: Column, j: Column) -> Column:
        to, t = F.get("near", j), (a - 1.0) * drawn(j) + 1.0
        return F.abs(to - v) * F.exp(spiral * t) * F.cos(_TURN * t) + to

    return _moved(rows, F.transform("x", gene), low, high, objective, "flame", "flame_f")


def firefly_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    alpha: float = 1.0, decay: float = 0.92, beta: float = 1.0, gamma: float = 1.0,
) -> DataFrame:
    """Everyone is drawn to all that are brighter, the nearer the more, and strays a little; it stays where that is worse."""
    drawn, _ = _draws(seed, iteration)
    span, stray = high - low, alpha * decay ** (iteration - 1)
    rows = _swarmed(population, "f", "id")
    brighter = F.filter("swarm", lambda s: (s.f < F.col("f")) | ((s.f == F.col("f")) & (s.id < F.col("id"))))

    def pull(s: Column) -> Column:
        apart = F.aggregate(F.zip_with(s.x, "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d)
        return F.struct(s.x.alias("x"), (beta * F.exp(-gamma / span**2 * apart)).alias("w"))

    def sums(pulls: Column) -> Column:
        weight = F.aggregate(pulls, F.lit(0.0), lambda t, p: t + p.w)
        total = F.aggregate(pulls, F.transform("x", lambda _: F.lit(0.0)), lambda t, p: F.zip_with(t, p.x, lambda u, v: u + p.w * v))
        return F.struct(weight.alias("weight"), total.alias("total"))

    def drawn_in(s: Column) -> Column:
        share = F.least(s.weight, F.lit(1.0))
        return F.zip_with("x", s.total, lambda v, t: F.when(s.weight > 0, v + share * (t / F.when(s.weight > 0, s.weight) - v)).otherwise(v))

    pulled = once(once(F.transform(brighter, pull), sums), drawn_in)
    return _greedy(rows, F.transform(pulled, lambda v, j: v + stray * span * (drawn(j) - 0.5)), low, high, objective)


def flower_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    switch: float = 0.5, gamma: float = 0.5, exponent: float = 1.5,
) -> DataFrame:
    """Everyone takes a heavy-tailed step to the best, or one along the difference of two others; it stays where that is worse."""
    drawn, normal = _draws(seed, iteration)
    rows = _swarmed(population, "id")
    n = F.size("swarm")
    one = F.floor(drawn("one") * n).cast("int")
    two = F.floor(drawn("two") * (n - 1)).cast("int")
    rows = rows.withColumns({"one": one, "two": F.when(two >= one, two + 1).otherwise(two)})
    rows = rows.withColumns({"far": drawn("far") < switch, "part": drawn("part"), "a": F.get("swarm", F.col("one")).x, "b": F.get("swarm", F.col("two")).x})

    def gene(v: Column, j: Column) -> Column:
        step = levy_step(normal(j, "u"), normal(j, "v"), exponent)
        return F.when(F.col("far"), v + gamma * step * (F.get("best", j) - v)).otherwise(v + F.col("part") * (F.get("a", j) - F.get("b", j)))

    return _greedy(rows, F.transform("x", gene), low, high, objective)


def bat_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    loudness: float = 1.0, pulse: float = 0.5, alpha: float = 0.9, gamma: float = 0.9, slowest: float = 0.0, fastest: float = 2.0, local: float = 0.05,
) -> DataFrame:
    """Everyone flies by its velocity ``v`` or around the best; the louder it is (``loud``), the likelier it takes a place that is no worse."""
    drawn, normal = _draws(seed, iteration)
    if "v" not in population.columns:
        population = population.withColumns({"v": F.transform("x", lambda _: F.lit(0.0)), "loud": F.lit(loudness)})
    lead = population.groupBy("run").agg(F.min_by("x", F.struct("f", "id")).alias("best"))
    rate = F.lit(pulse) * (1.0 - F.exp(F.lit(-gamma * (iteration - 1))))
    walk = local * max(1.0 - progress, 1e-3) * (high - low)
    rows = population.join(lead, "run").withColumns({"speed": slowest + (fastest - slowest) * drawn("speed"), "near": drawn("near") > rate})
    flown = F.zip_with(F.zip_with("best", "x", lambda b, x: b - x), "v", lambda gap, v: v + gap * F.col("speed"))
    rows = rows.withColumn("v", flown)
    place = F.when(F.col("near"), F.transform("best", lambda b, j: b + walk * normal(j))).otherwise(F.zip_with("x", "v", lambda x, v: x + v))
    placed = _placed(rows, place, low, high, objective)
    taken = (F.col("_f") <= F.col("f")) & (drawn("taken") < F.col("loud"))
    placed = placed.withColumn("taken", taken)
    picked = {"x": "_x", "f": "_f"}
    return placed.select("run", "id", *[F.when(F.col("taken"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in picked.items()], "v",
                         F.when(F.col("taken"), F.col("loud") * alpha).otherwise(F.col("loud")).alias("loud"))


def annealing_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    temperature: float = 1.0, cooling: float = 0.995, step: float = 0.1,
) -> DataFrame:
    """Each individual is a chain of its own: a normal step, taken if it is better, or by chance while it is warm."""
    drawn, normal = _draws(seed, iteration)
    now = temperature * cooling ** (iteration - 1)
    scale = step * (high - low) * max(now / temperature, 1e-12) ** 0.5
    placed = _placed(population, F.transform("x", lambda v, j: v + scale * normal(j)), low, high, objective)
    taken = accepted(F.col("f"), F.col("_f"), F.lit(now), drawn("taken"))
    placed = placed.withColumn("taken", taken)
    return placed.select("run", "id", F.when(F.col("taken"), F.col("_x")).otherwise(F.col("x")).alias("x"), F.when(F.col("taken"), F.col("_f")).otherwise(F.col("f")).alias("f"))


def ant_archive_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    ants: int = 30, intensification: float = 0.1, evaporation: float = 0.85,
) -> DataFrame:
    """The population is an archive: ants are drawn around its members, the better the likelier, as wide as the others are apart; the best stay.

    A new member takes the id of the one that it drives out, so a run keeps its ids.
    """
    swarm = population.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("f", "id", "x"))).alias("swarm"))
    k = F.size("swarm")
    raw = F.transform(F.sequence(F.lit(0), k - 1), lambda r: F.exp(-F.pow(r / (intensification * k), F.lit(2)) / 2.0))
    swarm = swarm.withColumn("w", raw).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, v: a + v))
    rows = swarm.withColumn("ant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ants - 1).cast("long"))))

    def drawn(*parts) -> Column:
        return uniform(seed, iteration, F.col("run"), F.col("ant"), *parts)

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("nth"))
    mark = once(drawn("guide") * F.col("total"), lambda m: F.aggregate("w", start, lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["nth"] + F.when(a["sum"] + v <= m, 1).otherwise(0)).alias("nth"))))
    def wide(guide: Column) -> Column:
        apart = F.aggregate("swarm", F.transform(guide, lambda _: F.lit(0.0)), lambda a, s: F.zip_with(a, F.zip_with(s.x, guide, lambda p, q: F.abs(p - q)), lambda u, v: u + v))
        return F.struct(guide.alias("guide"), F.transform(apart, lambda d: F.greatest(evaporation * d / (k - 1), F.lit(1e-12))).alias("width"))

    def ant(s: Column) -> Column:
        def gene(g: Column, j: Column) -> Column:
            normal = F.sqrt(-2.0 * F.log(1.0 - drawn(j, "radius"))) * F.cos(_TURN * drawn(j, "angle"))
            return g + F.get(s.width, j) * normal

        return F.transform(s.guide, gene)

    place = once(once(F.get("swarm", F.least(mark["nth"], k - 1)).x, wide), ant)
    made = rows.withColumn("x", clipped(place, low, high)).select("run", F.col("ant").alias("id"), F.lit(1).alias("new"), "x")
    both = population.select("run", "id", F.lit(0).alias("new"), "x", "f").unionByName(made.withColumn("f", objective(F.col("x"))))
    ranked = both.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy("f", "new", "id")))
    names = population.select("run", F.col("id").alias("name"), F.row_number().over(Window.partitionBy("run").orderBy("f", "id")).alias("nth"))
    return ranked.join(names, ["run", "nth"]).select("run", F.col("name").alias("id"), "x", "f")


STEPS = {
    "whale": whale_step, "moth_flame": moth_flame_step, "firefly": firefly_step, "flower": flower_step,
    "bat": bat_step, "annealing": annealing_step, "ant_archive": ant_archive_step,
}
