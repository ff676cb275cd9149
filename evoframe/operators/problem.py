"""What a search works on: a box, its dimension, and one or several objectives as Column functions, minimized or maximized."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.operators.objectives import clipped


@dataclass(frozen=True)
class Problem:
    """``objective`` takes an array and gives a number, or with several ``names`` an array of as many.

    With ``maximize`` values are turned round inside, so that every search minimizes; ``original`` turns them back.
    """

    objective: Callable[[Column], Column]
    dimension: int
    low: float
    high: float
    names: tuple[str, ...] = ("f",)
    maximize: bool = False

    def __post_init__(self):
        if self.dimension < 1 or not self.low < self.high or not self.names:
            raise ValueError("a problem has a dimension, a box with low below high, and an objective")

    def repaired(self, x: Column) -> Column:
        """Moved into the box."""
        return clipped(x, self.low, self.high)

    def guarded(self, x: Column) -> Column:
        """``x``, an error where it is not of the problem's dimension."""
        right = F.assert_true(F.size(x) == self.dimension, F.concat(F.lit(f"a solution has {self.dimension} numbers, not "), F.size(x).cast("string"))).isNull()
        return F.when(right, x)

    def __call__(self, x: Column) -> Column:
        """The value, or the array of values, of a solution, to be minimized."""
        value, sign = self.objective(self.guarded(x)), -1.0 if self.maximize else 1.0
        if len(self.names) == 1:
            return value * sign
        right = F.assert_true(F.size(value) == len(self.names), F.lit(f"there are {len(self.names)} objectives")).isNull()
        return F.when(right, F.transform(value, lambda v: v * sign))

    def evaluated(self, population: DataFrame) -> DataFrame:
        """``population`` with ``f``."""
        return population.withColumn("f", self(F.col("x")))

    def original(self, f: Column) -> Column:
        """A value in the problem's own sense."""
        sign = -1.0 if self.maximize else 1.0
        return f * sign if len(self.names) == 1 else F.transform(f, lambda v: v * sign)


def log_scaled(exponent: Column) -> Column:
    """A number searched for by its exponent to base 10."""
    return F.pow(F.lit(10.0), exponent)
