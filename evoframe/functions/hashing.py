"""Order by a seeded hash: the engine's replacement for a random permutation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: str) -> Column:
    """md5 of the seed and the keys, the same at any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def first_by_hash(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly ``n`` rows, the first by ``hash_order``; ``keys`` tell the rows apart.

    A histogram of the first 16 bits (at most 65,536 rows for the driver) shows where the
    n-th row lies, so only the rows of one bucket are ranked and nothing is sorted whole.
    """
    marked = rows.withColumn("_hash", hash_order(seed, *keys)).withColumn("_head", F.substring("_hash", 1, 4))
    left, border = n, None
    for row in sorted(marked.groupBy("_head").count().collect(), key=lambda r: r["_head"]):
        if left <= row["count"]:
            border = row["_head"]
            break
        left -= row["count"]
    if border is None:
        return rows
    ranked = marked.where(F.col("_head") == border).withColumn("_nth", F.row_number().over(Window.partitionBy("_head").orderBy("_hash", *keys)))
    ranked = ranked.where(F.col("_nth") <= left).drop("_nth")
    return marked.where(F.col("_head") < border).unionByName(ranked).drop("_hash", "_head")


def share(size: int, part: float) -> int:
    """``part`` of ``size``, rounded half to even, one at least and one less than all at most."""
    return max(1, min(round(part * size), size - 1))


def cuts_of(rows: DataFrame, column: str, parts: int) -> list[float]:
    """Numbers that cut the rows into about equal ranges of a column, at most ``parts - 1`` and fixed from here on."""
    found = rows.agg(F.percentile_approx(F.col(column).cast("double"), [k / parts for k in range(1, parts)])).first()[0] if parts > 1 else None
    return sorted(set(found or ()))


def range_of(column: Column, cuts: list[float]) -> Column:
    """Which of the ranges a value lies in, from 0, where it is null too; the same wherever it is worked out.

    A tree of comparisons, so a row takes as many as the logarithm of the cuts.
    """
    value = column.cast("double")

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(cuts[middle]) < value, among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def _over_ranges(rows: DataFrame, group: str, order: str, ties: tuple, value: Column, name: str, parts: int | None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows in front of each within its group, range by range.

    There are as many ranges as shuffle partitions, if their number is not given; it changes no result.
    """
    cuts = cuts_of(rows, order, parts or max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    dealt = rows.withColumns({"_range": range_of(F.col(order), cuts), "_value": value})
    counts = dealt.groupBy(group, "_range").agg(F.sum("_value").alias("_n"))
    front = Window.unboundedPreceding, -1
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(*front))
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_value").over(Window.partitionBy(group, "_range").orderBy(order, *ties).rowsBetween(*front)), F.lit(0))
    placed = dealt.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)


def ranked_within(rows: DataFrame, group: str, order: str, name: str, *ties: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the rank from 0 by ``order``, a number, and ``ties`` within each group.

    Ranges of ``order`` are ranked each for itself and begin where the ranges before them
    end, so a group that holds most rows is spread over all tasks.
    """
    return _over_ranges(rows, group, order, ties, F.lit(1).cast("long"), name, parts)


def summed_within(rows: DataFrame, group: str, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of smaller ``order``, a number without ties, in the same group; by ranges."""
    return _over_ranges(rows, group, order, (), F.col(value).cast("long"), name, parts)


def summed_before(rows: DataFrame, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows of smaller ``order``, a number without ties; by ranges, as ``ranked_within``."""
    one = rows.withColumn("_all", F.lit(0))
    return _over_ranges(one, "_all", order, (), F.col(value).cast("long"), name, parts).drop("_all")


def number_of(seed: int, *keys: str) -> Column:
    """52 bits of ``hash_order`` as a number."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("long")


def permuted(value: Column, size: int, seed: int) -> Column:
    """A permutation of 0 .. size - 1, evaluated for one number: its first n values are n distinct draws, without a sort.

    Four rounds over a grid that is hardly larger than ``size``; what falls outside walks on
    along its cycle. A walk longer than 64 steps has a chance below ``size ** -32`` and is an error.
    """
    rows = math.isqrt(max(size - 1, 0)) + 1
    columns = -(-size // rows)

    def mixed(x: Column, number: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(number)), x.cast("string"))), 1, 13), 16, 10).cast("long")

    def once(value: Column, body) -> Column:
        """``body`` of a value that is worked out once, however often ``body`` names it."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def half(number: int, of_left: bool):
        def turn(s: Column) -> Column:
            left = (s.left + mixed(s.right, number)) % rows if of_left else s.left
            right = s.right if of_left else (s.right + mixed(s.left, number)) % columns
            return F.struct(left.alias("left"), right.alias("right"))

        return turn

    def step(v: Column) -> Column:
        left = F.round((v - v % columns) / columns).cast("long")  # whole, so rounding mends what division loses
        s = F.struct(left.alias("left"), (v % columns).alias("right"))
        for number in range(4):
            s = once(s, half(number, number % 2 == 0))
        return once(s, lambda t: t.left * columns + t.right)

    walk = F.sequence(F.lit(1), F.lit(max(1, min(64, rows * columns - size + 1))))
    start = F.struct(value.cast("long").alias("v"), F.lit(False).alias("done"))
    end = F.aggregate(walk, start, lambda a, _: F.when(a.done, a).otherwise(once(step(a.v), lambda v: F.struct(v.alias("v"), (v < size).alias("done")))))
    return F.when(end.done, end.v).otherwise(F.raise_error(F.lit("a permutation walked too far")).cast("long"))
