"""Pareto utilities: all objectives are minimized."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.hashing import cuts_of, range_of, ranked_within
from evoframe.functions.lineage import checkpointed


def dominates(a: list[Column], b: list[Column]) -> Column:
    """No objective worse and one better."""
    no_worse, better = F.lit(True), F.lit(False)
    for x, y in zip(a, b):
        no_worse, better = no_worse & (x <= y), better | (x < y)
    return no_worse & better


def front_of_two(points: DataFrame, f1: str, f2: str, key: str, unique: bool = True) -> DataFrame:
    """The points that none dominates, sorted by the first objective; of equal ones the smallest key.

    A point survives if its second objective is below all of those with a smaller first
    one, and the least for its own. Blocks of the first objective are bounded by their
    least second objective (one row for each block), so no window holds all points.
    """
    best = points.groupBy(f1).agg(F.min(f2).alias("_least"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = best.withColumn("_block", range_of(F.col(f1), cuts_of(points, f1, parts)))
    lows = blocks.groupBy("_block").agg(F.min("_least").alias("_low"))
    before = F.min("_low").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # one row for a range
    lows = lows.withColumn("_earlier", before).select("_block", "_earlier")
    inside = F.min("_least").over(Window.partitionBy("_block").orderBy(f1).rowsBetween(Window.unboundedPreceding, -1))
    marked = blocks.withColumn("_inside", inside).join(F.broadcast(lows), "_block")
    alive = marked.where(F.coalesce(F.col("_least") < F.least("_inside", "_earlier"), F.lit(True))).select(f1, F.col("_least").alias(f2))
    found = points.join(alive, [f1, f2])
    if unique:
        found = found.groupBy(f1, f2).agg(F.min(key).alias(key))
    return found.orderBy(f1, key)


def _undominated(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows of ``values`` no row of ``others`` dominates."""
    alive = np.ones(len(values), bool)
    for row in others:
        alive &= ~((row <= values).all(axis=1) & (row < values).any(axis=1))
    return alive


def front(points: DataFrame, objectives: list[str], key: str, block: int = 4096) -> DataFrame:
    """The points that none dominates, for any number of objectives.

    Each block of points keeps its own front; then every block of what is left is held
    against every other, by an equality join on the blocks' numbers. Null and NaN
    objectives take no part; equal points all stay.
    """
    sound = F.lit(True)
    for f in objectives:
        sound = sound & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    points = points.where(sound)
    schema = points.schema

    def own(batch: pd.DataFrame) -> pd.DataFrame:
        values = batch[objectives].to_numpy(float)
        return batch[_undominated(values, values)]

    left = checkpointed(points.repartition(max(1, -(-points.count() // block)), key).mapInPandas(lambda batches: map(own, batches), schema))
    blocks = max(1, -(-left.count() // block))
    dealt = left.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    rivals = left.select(*objectives).distinct()
    rivals = rivals.withColumn("_rival", F.pmod(F.xxhash64(*objectives), F.lit(blocks)))
    packs = rivals.groupBy("_rival").agg(F.collect_list(F.array(*[F.col(f).cast("double") for f in objectives])).alias("_rivals"))  # a block each
    packs = packs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def lost(r: Column) -> Column:
        return dominates([r[i] for i in range(len(objectives))], [F.col(f).cast("double") for f in objectives])

    beaten = dealt.join(packs, "_block").where(F.exists("_rivals", lost)).select(key).distinct()
    return left.join(beaten, key, "left_anti")


def front_numbers(points: DataFrame, objectives: list[str], key: str, run: str) -> DataFrame:
    """``run, key, front``: for each run's population the number of each point's front, from 0.

    A population is a group of bounded size, as search makes it; populations are dealt
    over all tasks, and their fronts are peeled off one after the other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def peel(population: pd.DataFrame) -> pd.DataFrame:
        values, number = population[objectives].to_numpy(float), np.full(len(population), -1, np.int64)
        left, n = np.arange(len(values)), 0
        while len(left):
            best = _undominated(values[left], values[left])
            number[left[best]] = n
            left, n = left[~best], n + 1
        return population[[run, key]].assign(front=number)

    columns = list(dict.fromkeys([run, key, *objectives]))
    return points.select(*columns).groupBy(run).applyInPandas(peel, f"`{run}` {kinds[run]}, `{key}` {kinds[key]}, front long")


def _climbed(values: np.ndarray, stairs: list[tuple[list, list]], last: tuple | None, at: int) -> tuple[list[int], tuple | None, int]:
    """Front numbers of points of three objectives in their lexicographic order, after those that ``stairs`` sums up.

    All points before one are no worse in the first objective, so one of them dominates it if
    it is no worse in the other two and not equal. ``stairs`` holds for each front the second
    and third objectives of its points that no other of it beats there: the second rises, the
    third falls. What a front beats, the front before it beats too, so a binary search finds a
    point's front. Equal points follow one another and share a number; ``last`` and ``at`` are
    the last point and its number.
    """
    numbers = []
    for point in map(tuple, values.tolist()):
        if point != last:
            _, y, z = point
            low, high = 0, len(stairs)
            while low < high:
                middle = (low + high) // 2
                ys, zs = stairs[middle]
                i = bisect_right(ys, y)
                low, high = (middle + 1, high) if i and zs[i - 1] <= z else (low, middle)
            if low == len(stairs):
                stairs.append(([], []))
            ys, zs = stairs[low]
            i = j = bisect_left(ys, y)
            while j < len(zs) and zs[j] >= z:
                j += 1
            ys[i:j], zs[i:j] = [y], [z]
            last, at = point, low
        numbers.append(at)
    return numbers, last, at


def _sound(objectives: list[str]) -> Column:
    """Neither null nor NaN."""
    sound = F.lit(True)
    for f in objectives:
        sound = sound & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return sound


def fronts_in_blocks(points: DataFrame, objectives: list[str], key: str, run: str, block: int = 65536) -> DataFrame:
    """``run, key, front``: as ``front_numbers``, for populations of any size and three objectives at most.

    Each population is cut into blocks of ``block`` points in the lexicographic order of the
    objectives. First blocks are numbered, of all populations at once, then second ones, and so
    on; a block goes on from what ``_climbed`` keeps of those before it. A task holds one block
    and that summary; work is the number of points times the logarithms of fronts and of a
    front's points. Points with null or NaN objectives beat none and are beaten by none, so they are in
    front 0, as in ``front_numbers``; equal points share a number.
    """
    if not 1 <= len(objectives) <= 3:
        raise ValueError("one to three objectives")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    columns = [F.col(f).cast("double") for f in objectives] + [F.lit(0.0)] * (3 - len(objectives))
    rows = points.where(_sound(objectives)).select(F.col(run).alias("_run"), F.col(key).alias("_key"), *[c.alias(n) for c, n in zip(columns, "xyz")])
    rows = ranked_within(rows, "_run", "x", "_nth", "y", "z")
    rows = checkpointed(rows.withColumn("_block", F.floor(F.col("_nth") / block)))
    schema = f"_run {kinds[run]}, _key {kinds[key]}, front long, sizes array<bigint>, stairs binary, last array<double>, at long"
    names = ["_run", "_key", "front", "sizes", "stairs", "last", "at"]
    last_block = rows.agg(F.max("_block")).first()[0]

    def number(own: pd.DataFrame, before: pd.DataFrame | None, go_on: bool) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=names, dtype=object)
        own, stairs, last, at = own.sort_values("_nth"), [], None, 0
        if before is not None and len(before):
            row = before.iloc[0]
            flat, ends = np.frombuffer(row.stairs, float).reshape(2, -1), np.cumsum(row.sizes)
            stairs = [tuple(side[end - size : end].tolist() for side in flat) for size, end in zip(row.sizes, ends)]
            last, at = tuple(row["last"]), int(row["at"])
        numbers, last, at = _climbed(own[["x", "y", "z"]].to_numpy(float), stairs, last, at)
        found = pd.DataFrame({"_run": own._run, "_key": own._key, "front": numbers}).assign(sizes=None, stairs=None, last=None, at=None)
        if not go_on:
            return found
        data = np.array([sum((ys for ys, _ in stairs), []), sum((zs for _, zs in stairs), [])]).tobytes()
        kept = pd.DataFrame({"_run": own._run.iloc[:1], "_key": None, "front": None, "sizes": [[len(ys) for ys, _ in stairs]], "stairs": [data], "last": [list(last)], "at": [at]})
        return pd.concat([found.astype(object), kept.astype(object)], ignore_index=True)[names]

    def begun(go_on: bool):
        return lambda own: number(own, None, go_on)

    def continued(go_on: bool):
        return lambda own, before: number(own, before, go_on)

    done = state = None
    for b in range((-1 if last_block is None else last_block) + 1):
        own, go_on = rows.where(F.col("_block") == b).groupBy("_run"), b < last_block
        if state is None:
            numbered = own.applyInPandas(begun(go_on), schema)
        else:
            numbered = own.cogroup(state.groupBy("_run")).applyInPandas(continued(go_on), schema)
        numbered = checkpointed(numbered)
        state, found = numbered.where("stairs IS NOT NULL"), numbered.where("stairs IS NULL")
        done = found if done is None else done.unionByName(found)
    rest = points.where(~_sound(objectives)).select(run, key, F.lit(0).cast("long").alias("front"))
    return rest if done is None else done.select(F.col("_run").alias(run), F.col("_key").alias(key), "front").unionByName(rest)


def _chained(values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Front numbers of a block in an order in which no point dominates an earlier one, each ``least`` at least."""
    number = least.copy()
    for i in range(1, len(values)):
        beaten = (values[:i] <= values[i]).all(axis=1) & (values[:i] < values[i]).any(axis=1)
        if beaten.any():
            number[i] = max(number[i], number[:i][beaten].max() + 1)
    return number


def fronts_of_all(points: DataFrame, objectives: list[str], key: str, block: int | None = None) -> DataFrame:
    """``key, front``: the number of each point's front, from 0, in one population of any size.

    Up to three objectives are numbered by ``fronts_in_blocks``, more by comparing blocks. Points
    with null or NaN objectives take no part.
    """
    if len(objectives) > 3:
        return _fronts_by_comparing(points, objectives, key, block or 4096)
    found = fronts_in_blocks(points.where(_sound(objectives)).withColumn("_one", F.lit(0)), objectives, key, "_one", block or 65536)
    return found.select(key, "front")


def _fronts_by_comparing(points: DataFrame, objectives: list[str], key: str, block: int) -> DataFrame:
    """``key, front`` for any number of objectives.

    A point's number is that of the longest chain of points that dominate one another up to
    it. Who dominates has the smaller sum of objectives, so blocks of points in the order of
    the sum are numbered one after the other: each is held against all points numbered
    before it, in every partition of theirs at once, and the highest number of a dominating
    one is kept for each of its points; then it is numbered by itself. A block, of about
    ``block`` points, is all that reaches a task beside a batch of the others, and only bounds between blocks reach
    the driver. Work grows with the square of the points, as the task asks in the worst case,
    over all tasks. Points with null or NaN objectives take no part; equal points share a number.
    """
    sound, total = F.lit(True), F.lit(0.0)
    for f in objectives:
        sound, total = sound & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")), total + F.col(f).cast("double")
    kind, width = points.schema[key].dataType.simpleString(), len(objectives)
    rows = points.where(sound).select(F.col(key).alias("k"), F.array(*[F.col(f).cast("double") for f in objectives]).alias("v"), total.alias("s"))
    rows = checkpointed(rows)
    cuts = cuts_of(rows, "s", max(1, -(-rows.count() // block)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        values = np.array(group.v.tolist(), float)
        order = np.lexsort((*values.T[::-1], group.s.to_numpy()))  # sums may round to one value; then the objectives order what dominates
        return pd.DataFrame({"b": [group.b.iloc[0]], "keys": [group.k.to_numpy()[order].tolist()], "data": [values[order].tobytes()]})

    packs = checkpointed(rows.withColumn("b", range_of(F.col("s"), cuts)).groupBy("b").applyInPandas(pack, f"b int, keys array<{kind}>, data binary"))

    def matrix(data: bytes) -> np.ndarray:
        return np.frombuffer(data, float).reshape(-1, width)

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The highest number, and 1, of those of one block that dominate each point of another."""
        for batch in batches:
            for row in batch.itertuples():
                values, front = matrix(row.data), np.asarray(row.fronts, np.int64)
                least = [int(front[h].max()) + 1 if (h := (values <= mine).all(axis=1) & (values < mine).any(axis=1)).any() else 0 for mine in matrix(row.own)]
                yield pd.DataFrame({"place": np.arange(len(least)), "least": least})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fronts = [_chained(matrix(row.data), np.asarray(row.least, np.int64) if row.least is not None else np.zeros(len(matrix(row.data)), np.int64)).tolist() for row in batch.itertuples()]
            yield batch[["b", "keys", "data"]].assign(fronts=fronts)

    done = None
    for b in sorted(r.b for r in packs.select("b").collect()):
        own = packs.where(F.col("b") == b)
        if done is None:
            own = own.withColumn("least", F.lit(None).cast("array<bigint>"))
        else:  # one row of bounded size meets one row for each block before it
            met = done.select("data", "fronts").withColumn("one", F.lit(1)).join(F.broadcast(own.select(F.col("data").alias("own"), F.lit(1).alias("one"))), "one")
            best = met.mapInPandas(hold, "place long, least long").groupBy("place").agg(F.max("least").alias("least"))
            best = best.agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("l")).select(F.transform("l", lambda p: p.least).alias("least"), F.lit(1).alias("one"))
            own = own.withColumn("one", F.lit(1)).join(best, "one")
        numbered = checkpointed(own.select("b", "keys", "data", "least").mapInPandas(chain, f"b int, keys array<{kind}>, data binary, fronts array<bigint>"))
        done = numbered if done is None else done.unionByName(numbered)
    if done is None:
        return rows.select(F.col("k").alias(key), F.lit(0).cast("long").alias("front"))
    return done.select(F.explode(F.arrays_zip("keys", "fronts")).alias("z")).select(F.col("z.keys").alias(key), F.col("z.fronts").alias("front"))


def pareto_order(points: DataFrame, objectives: list[str], key: str, run: str, large: bool = False) -> DataFrame:
    """``points`` with ``front``, ``crowding`` and ``place``: by front, then the most isolated first, then by key.

    ``large`` populations are numbered in blocks.
    """
    numbers = fronts_in_blocks if large else front_numbers
    numbered = points.join(numbers(points, objectives, key, run), [run, key])
    found = crowding_distance(numbered, objectives, key, [run, "front"])
    order = Window.partitionBy(run).orderBy("front", F.desc("crowding"), key)
    return found.withColumn("place", F.row_number().over(order))


def crowding_distance(points: DataFrame, objectives: list[str], key: str, front: str | list[str]) -> DataFrame:
    """``points`` with ``crowding`` within each front: infinite at the ends, else the sum of the neighbours' spreads."""
    total, groups = F.lit(0.0), [front] if isinstance(front, str) else front
    for f in objectives:
        order, whole = Window.partitionBy(*groups).orderBy(f, key), Window.partitionBy(*groups)
        spread = F.max(f).over(whole) - F.min(f).over(whole)
        gap = F.lead(f).over(order) - F.lag(f).over(order)
        part = F.when(gap.isNull(), F.lit(float("inf"))).when(spread == 0, F.lit(0.0)).otherwise(gap / F.when(spread != 0, spread))
        points = points.withColumn(f"_c_{f}", part)
        total = total + F.col(f"_c_{f}")
    return points.withColumn("crowding", total).drop(*[f"_c_{f}" for f in objectives])
