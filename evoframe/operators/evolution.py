"""Search for trade-offs between several objectives: elitist generations by fronts and crowding, and the archive of what was found.

A population is a table ``run, id, x, f`` with an array of objectives ``f``, all minimized.
Runs are groups of bounded size and never meet, so they spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.lineage import checkpointed
from evoframe.operators import pareto, selection
from evoframe.operators.budget import Budget
from evoframe.operators.objectives import clipped
from evoframe.operators.search import uniform

Objectives = Callable[[Column], Column]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread(points: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """``points`` with a column for each objective."""
    names = [f"_f{k}" for k in range(n)]
    return points.withColumns({name: F.get("f", F.lit(k)) for k, name in enumerate(names)}), names


def ranked(population: DataFrame, n: int) -> DataFrame:
    """``population`` with ``front`` and ``crowding`` by its ``n`` objectives."""
    points, names = _spread(population, n)
    return pareto.pareto_order(points, names, "id", "run").select(*population.columns, "front", "crowding")


def offspring(
    rated: DataFrame, iteration: int, progress: float, low: float, high: float, objectives: Objectives, seed: int = 0,
    crossover_rate: float = 0.9, mutation_rate: float | None = None, mutation_scale: float = 0.1, blend_alpha: float = 0.5, last_id: int | None = None,
) -> DataFrame:
    """``run, id, child, x, f``: as many children as each run of ``ranked`` has members.

    Two children come from two parents, each the winner of a tournament of two: by front,
    then by crowding. With the crossover rate their genes are drawn from the parents' range
    widened by ``blend_alpha``; genes mutate at the mutation rate (one in a child) by normal
    steps that shrink with the progress. Ids go on from ``last_id``, or the run's largest.
    """
    if not 0 <= crossover_rate <= 1 or (mutation_rate is not None and not 0 <= mutation_rate <= 1) or mutation_scale <= 0 or blend_alpha < 0:
        raise ValueError("rates are in [0, 1], the scale above 0, blend_alpha not below 0")
    swarm = rated.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("id", "front", "crowding", "x"))).alias("swarm"))
    rows = swarm.withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.size("swarm").cast("long") - 1)))
    pair = F.floor(F.col("child") / 2).cast("long")

    def drawn(*parts) -> Column:
        return uniform(seed, iteration, F.col("run"), *parts)

    def entrant(place: int) -> Column:
        return F.get("swarm", F.floor(drawn(pair, f"entrant{place}") * F.size("swarm")).cast("int"))

    def winner(place: int) -> Column:
        def judged(e: Column) -> Column:
            a, b = F.get(e, F.lit(0)), F.get(e, F.lit(1))
            first = (a.front < b.front) | ((a.front == b.front) & (a.crowding > b.crowding))
            return F.when(first, a.x).otherwise(b.x)

        return once(F.array(entrant(place), entrant(place + 1)), judged)

    rows = rows.withColumns({"one": winner(0), "two": winner(2), "crossed": drawn(pair, "cross") < crossover_rate})
    own = F.when(F.col("child") % 2 == 0, F.col("one")).otherwise(F.col("two"))
    scale = mutation_scale * max(1.0 - progress, 1e-3) * (high - low)
    rate = F.lit(mutation_rate) if mutation_rate is not None else 1.0 / F.size("one")

    def gene(v: Column, j: Column) -> Column:
        a, b = F.get("one", j), F.get("two", j)
        least, most = F.least(a, b), F.greatest(a, b)
        wide = blend_alpha * (most - least)
        blended = (least - wide) + drawn(F.col("child"), j, "blend") * ((most + wide) - (least - wide))
        normal = F.sqrt(-2.0 * F.log(1.0 - drawn(F.col("child"), j, "radius"))) * F.cos(6.283185307179586 * drawn(F.col("child"), j, "angle"))
        step = F.when(drawn(F.col("child"), j, "mutate") < rate, scale * normal).otherwise(F.lit(0.0))
        return F.when(F.col("crossed"), blended).otherwise(v) + step

    last = F.array_max(F.transform("swarm", lambda s: s.id)) if last_id is None else F.lit(last_id)
    made = rows.withColumn("id", last + 1 + F.col("child"))
    made = made.withColumn("x", clipped(F.transform(own, gene), low, high)).select("run", "id", "child", "x")
    return made.withColumn("f", objectives(F.col("x")))


def survivors(merged: DataFrame, n: int, size: DataFrame) -> DataFrame:
    """Whole fronts in turn, the last one cut by crowding, until each run has as many as ``run, size`` says."""
    points, names = _spread(merged, n)
    placed = pareto.pareto_order(points, names, "id", "run").join(size, "run")
    return placed.where(F.col("place") <= F.col("size")).select("run", "id", "x", "f")


def generation(population: DataFrame, n: int, iteration: int, progress: float, low: float, high: float, objectives: Objectives, seed: int = 0, **rates) -> DataFrame:
    """The next generation ``run, id, x, f``: the best of parents and children, as many as before."""
    children = offspring(ranked(population, n), iteration, progress, low, high, objectives, seed, **rates)
    size = population.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    return survivors(population.select("run", "id", "x", "f").unionByName(children.drop("child")), n, size)


def pruned(archive: DataFrame, n: int, size: int) -> DataFrame:
    """Archives that have grown to twice ``size`` become their front, cut by crowding to ``size``; others stay as they are."""
    if size < 2:
        raise ValueError("an archive holds two points at least")
    counts = archive.groupBy("run").agg((F.count(F.lit(1)) >= 2 * size).alias("_full"))
    marked = archive.join(counts, "run")
    points, names = _spread(marked.where("_full").drop("_full"), n)
    fronts = pareto.front_numbers(points, names, "id", "run").where("front = 0").select("run", "id")
    kept = selection.capped(points.join(fronts, ["run", "id"]), names, "id", "run", size)
    return marked.where("NOT _full").select(*archive.columns).unionByName(kept.select(*archive.columns))


def front_of(archive: DataFrame, n: int) -> DataFrame:
    """``run, id, x, f``: the points of each run's archive that none dominates; of equal ones that of smallest id."""
    points, names = _spread(archive, n)
    best = points.join(pareto.front_numbers(points, names, "id", "run").where("front = 0").select("run", "id"), ["run", "id"])
    return best.groupBy("run", "f").agg(F.min_by(F.struct("id", "x"), "id").alias("b")).select("run", "b.id", "b.x", "f")


def evolve(
    population: DataFrame, objectives: Objectives, n: int, low: float, high: float, budget: Budget, archive_size: int = 200, seed: int = 0, **rates
) -> DataFrame:
    """``run, id, x, f``: the front of all that each run has evaluated, from a first population ``run, id, x``.

    Every evaluation goes to the archive, which is pruned when it has twice its size; patience plays no
    part. Where the evaluations run out within a generation, the rest of its children have
    infinite objectives. Population and archive are cut from their lineage after each generation.
    """
    counts = population.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    sizes = [r[0] for r in counts.select("size").distinct().collect()]
    if len(sizes) > 1:
        raise ValueError("runs of one search are alike in size")
    if not sizes:
        return population.withColumn("f", objectives(F.col("x"))).select("run", "id", "x", "f")
    size, evals, iteration = sizes[0], 0, 0
    last = population.agg(F.max("id")).first()[0]  # ids are never used twice, as the archive remembers those that died out

    def granted(batch: DataFrame, nth: Column) -> DataFrame:
        if budget.max_evals is None or budget.max_evals - evals >= size:
            return batch
        none = F.array_repeat(F.lit(float("inf")), n)
        return batch.withColumn("f", F.when(nth < budget.max_evals - evals, F.col("f")).otherwise(none))

    first = population.withColumn("f", objectives(F.col("x")))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1
    now = checkpointed(granted(first.withColumn("nth", nth), F.col("nth")).select("run", "id", "x", "f"))
    archive, evals = now, size
    while (budget.max_evals is None or evals < budget.max_evals) and (budget.max_iters is None or iteration < budget.max_iters):
        progress = max(evals / budget.max_evals if budget.max_evals else 0.0, iteration / budget.max_iters if budget.max_iters else 0.0)
        iteration += 1
        children = checkpointed(granted(offspring(ranked(now, n), iteration, min(progress, 1.0), low, high, objectives, seed, last_id=last, **rates), F.col("child")).drop("child"))
        last += size
        now = checkpointed(survivors(now.unionByName(children), n, counts))
        archive = checkpointed(pruned(archive.unionByName(children), n, archive_size))
        evals += size
    finite = ~F.exists("f", lambda v: F.isnan(v) | (v == float("inf")))
    return front_of(archive.where(finite), n)
