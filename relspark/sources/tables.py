"""In-memory and random tables, and rows and blocks by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_of(spark: SparkSession, rows: Sequence[Sequence[int | float | str]], columns: int | Sequence[str]) -> DataFrame:
    """A table of the given rows; columns: their number (A1, A2, ...) or names. Without rows all columns are ints."""
    names = [f"A{k + 1}" for k in range(columns)] if isinstance(columns, int) else list(columns)
    kinds = []
    for k in range(len(names)):
        seen = {type(r[k]) for r in rows}
        kinds.append("string" if str in seen else "double" if float in seen else "bigint" if any(abs(r[k]) >= 1 << 31 for r in rows) else "int")
    values = [tuple(float(v) if kind == "double" else v for v, kind in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def random_table(spark: SparkSession, columns: int, values: int, rows: int, seed: int = 0) -> DataFrame:
    """Uniform ints in [0, values), made where they are used. The same seed and partitioning give the same rows."""
    return spark.range(rows).select(*[F.floor(F.rand(seed + k) * values).cast("int").alias(f"A{k + 1}") for k in range(columns)])


def seeded_table(spark: SparkSession, rows: int, tops: Sequence[int], seed: int = 42) -> DataFrame:
    """A1: 0 to rows - 1; then a column for each top with values in [0, top), by a rule from row, column and seed alone, so the same anywhere."""
    spread = lambda k: F.pmod((F.col("id") + seed + 1) * F.lit(1103515245 + 2 * 12345 * k), F.lit(2147483647))
    values = [F.pmod(F.floor(spread(k) / 65536), F.lit(top)).cast("int").alias(f"A{k + 2}") for k, top in enumerate(tops)]
    return spark.range(rows).select(F.col("id").cast("int").alias("A1"), *values)


def rows_between(parquet: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows at places [start, stop) of a Parquet table: its files in order of name, the rows of each as they lie.

    Files are counted without reading a column; of the files that hold the places, at most stop - start, the bounds come to
    the driver, and the scan reads those files only.
    """
    path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counted = parquet.groupBy(path.alias("file")).agg(F.count("*").alias("n"))
    last = F.sum("n").over(Window.orderBy("file"))  # a row for each file
    held = counted.select("file", (last - F.col("n")).alias("first"), last.alias("last")).filter((F.col("last") > start) & (F.col("first") < stop)).collect()
    there = F.lit(False)
    for file, first, _ in held:
        there = there | ((path == file) & (at >= start - first) & (at < stop - first))
    return parquet.filter(path.isin([r.file for r in held]) & there)


def get_tuple(parquet: DataFrame, place: int) -> DataFrame:
    """The row at a place of a Parquet table; no row if there is none."""
    return rows_between(parquet, place, place + 1)


def get_block(parquet: DataFrame, block: int, block_size: int = 4) -> DataFrame:
    """A block of block_size consecutive rows of a Parquet table."""
    return rows_between(parquet, block * block_size, (block + 1) * block_size)


def get_dat_tuple(spark: SparkSession, path: str, place: int) -> DataFrame:
    """The row at a place of a dat table (its files in order of name); no row if there is none. Only that row is read."""
    return spark.read.format("dat").option("firstRow", place).option("rows", 1).load(path)


def get_dat_block(spark: SparkSession, path: str, block: int, block_size: int = 4) -> DataFrame:
    """A block of block_size consecutive rows of a dat table; only they are read."""
    return spark.read.format("dat").option("firstRow", block * block_size).option("rows", block_size).load(path)
