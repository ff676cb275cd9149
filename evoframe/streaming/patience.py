"""Budget and patience of runs whose iterations arrive as a stream: a few numbers of state for each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evoframe.operators.budget import Budget

_STATE = "evals long, iters long, best double, mark double, stalled long"
WATCHED = "run long, evals long, iters long, best double, stalled long, stopped_early boolean, done boolean"


class Patience(StatefulProcessor):
    """Folds a run's iterations ``iter, n, f`` in their order; a run that is over takes no more."""

    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        inf, budget = float("inf"), self.budget
        evals, iters, best, mark, stalled = self.state.get() if self.state.exists() else (0, 0, inf, inf, 0)

        def spent() -> bool:
            return any(most is not None and have >= most for have, most in ((evals, budget.max_evals), (iters, budget.max_iters)))

        def tired() -> bool:
            return budget.patience is not None and stalled >= budget.patience

        batch = pd.concat(list(rows)).sort_values("iter")  # a run's iterations of one micro-batch
        for n, f in zip(batch.n.tolist(), batch.f.tolist()):
            if spent() or tired():
                break
            evals, iters, best = evals + n, iters + 1, min(best, f)
            if best < mark - budget.min_delta:
                mark, stalled = best, 0
            else:
                stalled += 1
        self.state.update((int(evals), int(iters), float(best), float(mark), int(stalled)))
        yield pd.DataFrame({"run": [int(key[0])], "evals": [evals], "iters": [iters], "best": [best], "stalled": [stalled],
                            "stopped_early": [tired() and not spent()], "done": [tired() or spent()]})

    def close(self) -> None:
        pass


def watched(iterations: DataFrame, budget: Budget) -> DataFrame:
    """A run's state after each micro-batch that brings iterations ``run, iter, n, f`` of it, in the order of ``iter``.

    ``n`` evaluations and their least value ``f``. Needs the RocksDB state store; a restarted query goes on from its checkpoint.
    """
    found = iterations.select("run", "iter", "n", "f").groupBy("run")
    return found.transformWithStateInPandas(statefulProcessor=Patience(budget), outputStructType=WATCHED, outputMode="Update", timeMode="None")
