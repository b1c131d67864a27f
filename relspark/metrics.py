"""Statistics of a result, observed while it is computed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Stats:
    """tuples: rows; cells: rows times columns; seconds: of the action."""

    name: str
    tuples: int
    cells: int
    seconds: float

    def __str__(self) -> str:
        return f"{self.name} -- tuples: {self.tuples} -- cells: {self.cells} -- seconds: {self.seconds:.4f}"


def measured(df: DataFrame, action: Callable[[DataFrame], object] | None = None, name: str = "result") -> tuple[object, Stats]:
    """Runs the action (default: collect) and gives its value with the statistics; rows are counted on the executors."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("tuples"))
    began = time.perf_counter()
    value = (action or DataFrame.collect)(watched)
    spent = time.perf_counter() - began
    n = seen.get["tuples"]
    return value, Stats(name, n, n * len(df.columns), spent)
