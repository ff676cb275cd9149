"""Budgets and patience: in a search, replayed, and on a stream that is restarted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.operators import budget, objectives, search
from evoframe.operators.budget import Budget
from evoframe.streaming.patience import watched


def brute(values: list[float], size: int, b: Budget) -> tuple:
    evals = iters = stalled = 0
    best = mark = float("inf")

    def spent():
        return (b.max_evals is not None and evals >= b.max_evals) or (b.max_iters is not None and iters >= b.max_iters)

    for at in range(0, len(values), size):
        if spent() or (b.patience is not None and stalled >= b.patience):
            break
        some = values[at : at + size][: None if b.max_evals is None else b.max_evals - evals]
        evals, iters, best = evals + len(some), iters + 1, min([best, *some])
        mark, stalled = (best, 0) if best < mark - b.min_delta else (mark, stalled + 1)
    return evals, iters, best, stalled, b.patience is not None and stalled >= b.patience and not spent()


BUDGETS = [Budget(max_evals=23), Budget(max_iters=4), Budget(max_iters=100, patience=2), Budget(max_evals=40, max_iters=9, patience=3, min_delta=1.0), Budget(max_evals=1, patience=1)]


@pytest.fixture(scope="module")
def runs():
    draw = np.random.default_rng(12)
    return {r: np.minimum.accumulate(draw.normal(10, 3, int(draw.integers(1, 70)))).tolist() if r % 2 else draw.normal(10, 3, 50).tolist() for r in range(12)}


@pytest.mark.parametrize("b", BUDGETS)
def test_replayed(spark, runs, b):
    rows = spark.createDataFrame([(r, i, v) for r, values in runs.items() for i, v in enumerate(values)], "who long, i int, v double").repartition(4)
    found = {r.run: tuple(r)[1:] for r in budget.replayed(rows, "who", ["i"], "v", 5, b).collect()}
    assert found == {r: brute(values, 5, b) for r, values in runs.items()}


def test_wrong_budgets():
    for wrong in ({}, {"patience": 3}, {"max_iters": 5, "patience": 0}, {"max_iters": 5, "min_delta": -1.0}):
        with pytest.raises(ValueError):
            Budget(**wrong)


@pytest.mark.parametrize("b", [Budget(max_evals=25), Budget(max_iters=50, patience=2, min_delta=0.3), Budget(max_evals=10)])
def test_a_search_stops_run_by_run(spark, b):
    """A step that moves nothing in one run and halves the positions in the other."""
    start = spark.createDataFrame([(r, i, [1.0 + i, 2.0]) for r in (1, 2) for i in range(10)], "run long, id long, x array<double>")

    def halve(population, iteration, progress, low, high, objective, seed):
        x = F.when(F.col("run") == 1, F.transform("x", lambda v: v / 2)).otherwise(F.col("x"))
        return population.withColumn("x", x).withColumn("f", objective(F.col("x")))

    found = {r.run: tuple(r)[1:] for r in search.search(start, halve, objectives.sphere, -9.0, 9.0, b).collect()}
    for run in (1, 2):
        evals, iters, stalled, best, mark, step = min(10, b.max_evals or 10), 0, 0, 5.0, float("inf"), 0

        def spent(evals, iters):
            return (b.max_evals is not None and evals >= b.max_evals) or (b.max_iters is not None and iters >= b.max_iters)

        while not spent(evals, iters) and not (b.patience and stalled >= b.patience):
            step += 1
            evals, iters = min(evals + 10, b.max_evals or 10**9), iters + 1
            best = 5.0 / 4**step if run == 1 else 5.0
            mark, stalled = (best, 0) if best < mark - b.min_delta else (mark, stalled + 1)
        assert found[run] == (evals, iters, pytest.approx(best), stalled, bool(b.patience and stalled >= b.patience and not spent(evals, iters)))


def test_patience_on_a_stream_that_is_restarted(spark, runs, tmp_path):
    b = Budget(max_evals=60, patience=2, min_delta=0.5)
    rows = [(r, k // 5, len(v[k : k + 5]), min(v[k : k + 5])) for r, v in runs.items() for k in range(0, len(v), 5)]
    schema = "run long, iter long, n long, f double"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go() -> None:
        states = watched(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), b)
        query = states.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}"))
        query = query.option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        for low, high in ((0, 2), (2, 3), (3, 99)):  # two files, a restart, two more
            part = [r for r in rows if low <= r[1] < high]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            if low:
                go()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batches = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(batches) == 3
    states = spark.read.option("recursiveFileLookup", True).parquet(out)
    last = states.groupBy("run").agg(F.max_by(F.struct("evals", "iters", "best", "stalled", "stopped_early"), "batch").alias("s")).select("run", "s.*")
    found = {r.run: tuple(r)[1:] for r in last.collect()}
    assert found == {r: brute(v, 5, b) for r, v in runs.items()}
