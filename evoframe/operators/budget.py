"""Budgets and patience of many runs at once: state is a row for each run, and runs stop one by one.

A run ends when it has had ``max_evals`` evaluations or ``max_iters`` iterations, or, early,
when ``patience`` iterations in a row brought no fall of its best value by more than
``min_delta`` below the last one that counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "run long, evals long, iters long, best double, mark double, stalled long, done boolean"
_INF = float("inf")


@dataclass(frozen=True)
class Budget:
    max_evals: int | None = None
    max_iters: int | None = None
    patience: int | None = None
    min_delta: float = 0.0

    def __post_init__(self):
        if self.max_evals is None and self.max_iters is None:
            raise ValueError("a budget needs evaluations or iterations; patience shortens a run but does not bound it")
        if (self.patience is not None and self.patience < 1) or not self.min_delta >= 0:
            raise ValueError("patience is 1 at least, min_delta not below 0")

    def spent(self, evals: Column, iters: Column) -> Column:
        """Whether evaluations or iterations have run out."""
        tests = [have >= most for have, most in ((evals, self.max_evals), (iters, self.max_iters)) if most is not None]
        return tests[0] | tests[1] if len(tests) == 2 else tests[0]

    def over(self, evals: Column, iters: Column, stalled: Column) -> Column:
        """Whether a run stops."""
        out = self.spent(evals, iters)
        return out if self.patience is None else out | (stalled >= self.patience)

    def early(self, evals: Column, iters: Column, stalled: Column) -> Column:
        """Whether it was patience that ended a run."""
        return F.lit(False) if self.patience is None else (stalled >= self.patience) & ~self.spent(evals, iters)


def opened(runs: DataFrame) -> DataFrame:
    """The state of each run in front of its first evaluation."""
    zero = F.lit(0).cast("long")
    inf = F.lit(_INF)
    return runs.select("run").distinct().select("run", zero.alias("evals"), zero.alias("iters"), inf.alias("best"), inf.alias("mark"), zero.alias("stalled"), F.lit(False).alias("done"))


def granted(batch: DataFrame, state: DataFrame, budget: Budget) -> DataFrame:
    """``batch`` ``run, id, f`` of the runs that go on, with ``counted``; what is beyond a run's evaluations, by id, has an infinite ``f``."""
    left = F.lit(1 << 62) if budget.max_evals is None else F.lit(budget.max_evals) - F.col("evals")
    going = batch.join(state.where("NOT done").select("run", left.alias("_left")), "run")
    nth = F.row_number().over(Window.partitionBy("run").orderBy("id"))
    going = going.withColumn("counted", nth <= F.col("_left")).drop("_left")
    return going.withColumn("f", F.when(F.col("counted"), F.col("f")).otherwise(F.lit(_INF)))


def charged(batch: DataFrame, state: DataFrame, budget: Budget, iteration: bool = True) -> DataFrame:
    """The state of each run after the evaluations of ``granted``, and after the end of an iteration."""
    spent = batch.groupBy("run").agg(F.count_if("counted").alias("_n"), F.min("f").alias("_f"))
    joined = state.join(spent, "run", "left")
    evals, best = F.col("evals") + F.coalesce("_n", F.lit(0)), F.least("best", F.coalesce("_f", F.lit(_INF)))
    going = ~F.col("done")
    iters, mark, stalled = F.col("iters"), F.col("mark"), F.col("stalled")
    if iteration:
        better = best < mark - budget.min_delta
        iters = F.when(going, iters + 1).otherwise(iters)
        stalled = F.when(~going, stalled).when(better, 0).otherwise(stalled + 1)
        mark = F.when(going & better, best).otherwise(mark)
    after = joined.select("run", evals.alias("evals"), iters.alias("iters"), best.alias("best"), mark.alias("mark"), stalled.cast("long").alias("stalled"), "done")
    return after.withColumn("done", F.col("done") | budget.over(F.col("evals"), F.col("iters"), F.col("stalled")))


def replayed(rows: DataFrame, run: str, order: list[str], value: str, size: int, budget: Budget) -> DataFrame:
    """``run, evals, iters, best, stalled, stopped_early``: where recorded evaluations, ``size`` to an iteration, would have ended.

    The last iteration of a run may be short. Iterations are aggregated first, so a run's history is one number for each.
    """
    nth = F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1
    numbered = rows.select(F.col(run).alias("run"), F.col(value).cast("double").alias("f"), nth.alias("nth"))
    if budget.max_evals is not None:
        numbered = numbered.where(F.col("nth") < budget.max_evals)
    steps = numbered.groupBy("run", F.floor(F.col("nth") / size).alias("iter")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    history = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("iter", "n", "f"))).alias("h"))
    zero = F.lit(0).cast("long")
    inf = F.lit(_INF)
    start = F.struct(zero.alias("evals"), zero.alias("iters"), inf.alias("best"), inf.alias("mark"), zero.alias("stalled"))

    def fold(a: Column, s: Column) -> Column:
        best = F.least(a.best, s.f)
        better = best < a.mark - budget.min_delta
        next_ = F.struct((a.evals + s.n).alias("evals"), (a.iters + 1).alias("iters"), best.alias("best"),
                         F.when(better, best).otherwise(a.mark).alias("mark"), F.when(better, zero).otherwise(a.stalled + 1).alias("stalled"))
        return F.when(budget.over(a.evals, a.iters, a.stalled), a).otherwise(next_)

    ended = history.select("run", F.aggregate("h", start, fold).alias("s")).select("run", "s.evals", "s.iters", "s.best", "s.stalled")
    return ended.withColumn("stopped_early", budget.early(F.col("evals"), F.col("iters"), F.col("stalled")))
