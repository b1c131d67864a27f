"""Plans as text and as lists of physical operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """Spark's formatted plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def physical_nodes(df: DataFrame) -> list[str]:
    """The physical operators from the root down, as planned (before adaptive changes)."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [m[1] for line in lines if (m := re.match(r"[\s:+|-]*(?:\*\(\d+\) )?\*?\s*([A-Z]\w+)", line))]


def summary(df: DataFrame) -> str:
    """The operators that matter to a reader, indented, one per line."""
    shown = [n for n in physical_nodes(df) if n not in ("AdaptiveSparkPlan", "ColumnarToRow", "InputAdapter", "WholeStageCodegen")]
    return "\n".join(f"{'  ' * k}└─ {n}" for k, n in enumerate(shown))
