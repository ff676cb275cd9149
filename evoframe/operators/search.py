"""Population search as DataFrame steps, many independent runs at once.

A population is a table ``run, id, x, f``. A step is a join of each individual with what
its run shares (best, leaders), one expression for the new position and one for its
fitness; random numbers are hashes of (seed, run, iteration, id, coordinate), so a step
gives the same result at any partitioning and after a lost task. Runs never meet, so
they spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.functions.lineage import checkpointed
from evoframe.operators.budget import Budget, charged, granted, opened

Objective = Callable[[Column], Column]


def uniform(seed: int, iteration: int, *parts) -> Column:
    """A number in [0, 1) for each row and coordinate: 52 bits of md5, which any engine can repeat."""
    message = F.concat_ws("|", F.lit(str(seed)), F.lit(str(iteration)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(message), 1, 13), 16, 10).cast("double") / float(1 << 52)


def initial(spark: SparkSession, runs: int, size: int, dimension: int, low: float, high: float, objective: Objective, seed: int = 0) -> DataFrame:
    """``size`` points in the box for each run, with their fitness."""
    rows = spark.range(runs * size).select(F.floor(F.col("id") / size).cast("long").alias("run"), (F.col("id") % size).alias("id"))
    coordinates = F.sequence(F.lit(0), F.lit(dimension - 1))
    x = F.transform(coordinates, lambda j: low + (high - low) * uniform(seed, 0, F.col("run"), F.col("id"), j))
    return rows.withColumn("x", x).withColumn("f", objective(F.col("x")))


def best_of(population: DataFrame, k: int = 1) -> DataFrame:
    """``run, leaders``: the k best positions of each run, ties by id."""
    order = Window.partitionBy("run").orderBy("f", "id")
    first = population.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return first.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "x"))), lambda s: s.x).alias("leaders"))


def _scored(moved: DataFrame, x: Column, low: float, high: float, objective: Objective) -> DataFrame:
    inside = F.transform(x, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))
    return moved.withColumn("_x", inside).withColumn("_f", objective(F.col("_x")))


def grey_wolf_step(population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0) -> DataFrame:
    """Everyone moves to the mean of what the three leaders propose.

    A run of fewer than three has no such mean and goes to the lower end of the box, as in the SQL.
    """
    a = 2.0 * (1.0 - progress)
    joined = population.join(best_of(population, 3), "run")

    def proposal(j: Column, v: Column, leader: int) -> Column:
        r1 = uniform(seed, iteration, F.col("run"), F.col("id"), j, leader * 2)
        r2 = uniform(seed, iteration, F.col("run"), F.col("id"), j, leader * 2 + 1)
        to = F.get(F.get("leaders", F.lit(leader)), j)  # null where the run has fewer
        return to - a * (2.0 * r1 - 1.0) * F.abs(2.0 * r2 * to - v)

    x = F.transform("x", lambda v, j: (proposal(j, v, 0) + proposal(j, v, 1) + proposal(j, v, 2)) / 3.0)
    return _scored(joined, x, low, high, objective).select("run", "id", F.col("_x").alias("x"), F.col("_f").alias("f"))


def sine_cosine_step(population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0) -> DataFrame:
    """Everyone swings around the best by sine or cosine, with falling amplitude."""
    joined = population.join(best_of(population, 1), "run")
    reach = 2.0 * (1.0 - progress)

    def swung(v: Column, j: Column) -> Column:
        r = [uniform(seed, iteration, F.col("run"), F.col("id"), j, k) for k in range(3)]
        wave = F.when(r[2] < 0.5, F.sin(6.283185307179586 * r[0])).otherwise(F.cos(6.283185307179586 * r[0]))
        return v + reach * wave * F.abs(2.0 * r[1] * F.col("leaders")[0][j] - v)

    return _scored(joined, F.transform("x", swung), low, high, objective).select("run", "id", F.col("_x").alias("x"), F.col("_f").alias("f"))


def differential_step(population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0) -> DataFrame:
    """The generation's form of best/1/bin: a trial replaces its parent if it is not worse.

    Donors are the neighbours in a hashed order of the run, so they are distinct. A run's
    population is a bounded group, gathered once as one array in that order.
    """
    order = uniform(seed, iteration, F.col("run"), F.col("id"), "order")
    rings = population.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(order.alias("_u"), "id", "x", "f"))).alias("_ring"))
    best = F.array_min(F.transform("_ring", lambda s: F.struct(s.f.alias("f"), s.id.alias("id"), s.x.alias("x")))).x
    placed = rings.withColumn("_best", best).select("run", "_ring", "_best", F.posexplode("_ring").alias("_k", "_me"))

    def donor(step: int) -> Column:
        return F.get("_ring", F.pmod(F.col("_k") + step, F.size("_ring"))).x

    joined = placed.select("run", "_me.id", "_me.x", "_me.f", donor(1).alias("_x1"), donor(2).alias("_x2"), F.col("_best"))
    forced = F.floor(uniform(seed, iteration, F.col("run"), F.col("id"), "gene") * F.size("x")).cast("int")

    def gene(v: Column, j: Column) -> Column:
        taken = (uniform(seed, iteration, F.col("run"), F.col("id"), j) < 0.5) | (j == forced)
        return F.when(taken, F.col("_best")[j] + 0.6 * (F.col("_x1")[j] - F.col("_x2")[j])).otherwise(v)

    trial = _scored(joined, F.transform("x", gene), low, high, objective)
    better = F.col("_f") <= F.col("f")
    return trial.select("run", "id", F.when(better, F.col("_x")).otherwise(F.col("x")).alias("x"), F.least("_f", "f").alias("f"))


def grasshopper_step(
    population: DataFrame, iteration: int, progress: float, low: float, high: float, objective: Objective, seed: int = 0,
    c_max: float = 1.0, c_min: float = 4e-5, intensity: float = 0.6, attraction: float = 1.5,
) -> DataFrame:
    """Everyone moves to the best, pushed and pulled by all others of its run; nothing is drawn.

    A run's population is a bounded group, so it joins as one array.
    """
    c = c_max - (c_max - c_min) * progress
    swarm = population.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("swarm"), F.min_by("x", F.struct("f", "id")).alias("best"))
    joined = population.join(swarm, "run")

    def gap(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))

    joined = joined.withColumn("apart", F.transform("swarm", lambda s: gap(s.x, F.col("x"))))
    joined = joined.withColumn("largest", F.max(F.array_max("apart")).over(Window.partitionBy("run")))
    scaled = lambda d: F.when(F.col("largest") > 0, 1.0 + 3.0 * d / F.when(F.col("largest") > 0, F.col("largest"))).otherwise(F.lit(1.0))
    force = lambda d: intensity * F.exp(-scaled(d) / attraction) - F.exp(-scaled(d))
    pull = F.zip_with("swarm", "apart", lambda s, d: F.when(s.id == F.col("id"), F.lit(0.0)).otherwise(force(d) / (d + 1e-12)))
    joined = joined.withColumn("pull", pull)
    # vector by vector, so that each pull is worked out once and not again for every coordinate
    step = F.aggregate(
        F.zip_with("swarm", "pull", lambda s, p: F.struct(s.x.alias("x"), p.alias("p"))), F.transform("x", lambda _: F.lit(0.0)),
        lambda a, s: F.zip_with(a, F.zip_with(s.x, "x", lambda to, at: s.p * (to - at)), lambda u, v: u + v),
    )
    x = F.zip_with(step, "best", lambda s, b: c * (c * ((high - low) / 2.0) * s) + b)
    return _scored(joined, x, low, high, objective).select("run", "id", F.col("_x").alias("x"), F.col("_f").alias("f"))


def truncated(population: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each run with ``place``, ties by id."""
    order = Window.partitionBy("run").orderBy("f", "id")
    return population.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


STEPS = {"grasshopper": grasshopper_step, "grey_wolf": grey_wolf_step, "sine_cosine": sine_cosine_step, "differential": differential_step}


def random_points(boxes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``run, id, x``: ``n`` points for each row of ``boxes`` ``run, lows, highs``."""
    rows = boxes.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    x = F.transform(F.arrays_zip("lows", "highs"), lambda b, j: b.lows + (b.highs - b.lows) * uniform(seed, 0, F.col("run"), F.col("id"), j))
    return rows.select("run", "id", x.alias("x"))


def boxes_of(population: DataFrame) -> DataFrame:
    """``run, lows, highs``: the box that each run's positions span."""
    parts = population.select("run", F.posexplode("x").alias("_j", "_v")).groupBy("run", "_j").agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    sides = parts.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("_j", "_l", "_h"))).alias("_s"))
    return sides.select("run", F.transform("_s", lambda s: s._l).alias("lows"), F.transform("_s", lambda s: s._h).alias("highs"))


def search(
    population: DataFrame, step: str | Callable, objective: Objective, low: float, high: float, budget: Budget, seed: int = 0
) -> DataFrame:
    """``run, evals, iters, best, stalled, stopped_early`` of each run of a first population ``run, id, x``.

    A step is one of ``STEPS`` by name or a function like them; columns that it adds reach its
    next call. Runs that have ended leave the population, so work follows those that go on.
    A step reads its population several times, so each one is cut from its lineage by
    ``checkpoint`` into the shared folder, and so is the state, a row for each run.
    """
    first = population.withColumn("f", objective(F.col("x")))
    state = opened(population)
    first = checkpointed(granted(first, state, budget))
    state = checkpointed(charged(first, state, budget, iteration=False))
    population, iteration = first.drop("counted"), 0
    while going := state.where("NOT done").agg(F.count(F.lit(1)), F.min("evals")).first():
        if not going[0]:
            break
        # runs are alike in size, so the furthest behind tells how far the search is
        share = max(going[1] / budget.max_evals if budget.max_evals else 0.0, iteration / budget.max_iters if budget.max_iters else 0.0)
        iteration += 1
        population = population.join(state.where("NOT done").select("run"), "run", "left_semi")
        moved = (STEPS[step] if isinstance(step, str) else step)(population, iteration, min(share, 1.0), low, high, objective, seed)
        moved = checkpointed(granted(moved, state, budget))
        state = checkpointed(charged(moved, state, budget))
        population = moved.drop("counted")
    return state.select("run", "evals", "iters", "best", "stalled", budget.early(F.col("evals"), F.col("iters"), F.col("stalled")).alias("stopped_early"))
