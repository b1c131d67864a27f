"""Layouts that play the part of indexes: how rows are stored decides what a scan can skip.

HashLayout         a bucketed table: equality reads one bucket, joins on the key need no exchange
AdaptiveHashLayout the same with the number of buckets derived from the row count, and Bloom filters on the key
RangeLayout        Parquet range-partitioned and sorted by the key: points and ranges skip by statistics
BlockIndex         a side table of (key, file, block of rows): files are looked up and read, then rows are checked again

A layout with a path can be opened again in another session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.functions.positional import as_literal, place_of
from relspark.sources.tables import rows_between


class Layout:
    """Base: a layout is built once; a search before that is a RuntimeError."""

    def __init__(self) -> None:
        self.column: str | None = None
        self.spark: SparkSession | None = None

    def _built(self) -> str:
        if self.column is None:
            raise RuntimeError("the layout is not built")
        return self.column

    def table(self) -> DataFrame:
        """All rows, in the layout."""
        raise NotImplementedError

    def build(self, df: DataFrame, column: int | str) -> Layout:
        raise NotImplementedError

    def _key(self, df: DataFrame) -> Column:
        return df[f"`{self._built()}`"]

    def _value(self, value: object) -> Column:
        df = self.table()
        return F.lit(as_literal(value, df.schema[self._built()].dataType))

    def search(self, value: object) -> DataFrame:
        df = self.table()
        return df.filter(self._key(df) == self._value(value))

    def range_search(self, low: object, high: object, open_low: bool = False, open_high: bool = False) -> DataFrame:
        raise TypeError(f"{type(self).__name__} serves points, not ranges")

    def stats(self) -> DataFrame:
        """Rows and distinct keys of each file of the layout."""
        df = self.table()
        return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.countDistinct(self._key(df)).alias("n_keys"))


class _Ranges:
    """Ranges by a pushed-down filter; both ends are included unless said otherwise."""

    def range_search(self, low: object, high: object, open_low: bool = False, open_high: bool = False) -> DataFrame:
        df = self.table()
        key, out = self._key(df), df
        if low is not None:
            out = out.filter(key > self._value(low) if open_low else key >= self._value(low))
        if high is not None:
            out = out.filter(key < self._value(high) if open_high else key <= self._value(high))
        return out


class HashLayout(Layout):
    """With a path the files lie there, and beside them (path + "_layout") what open() needs."""

    def __init__(self, buckets: int = 10, name: str | None = None, path: str | None = None) -> None:
        super().__init__()
        self.buckets, self.name, self.path = buckets, name or f"hash_layout_{uuid.uuid4().hex}", path and path.rstrip("/")

    def build(self, df: DataFrame, column: int | str) -> HashLayout:
        key = df.columns[place_of(df.columns, column)]
        return self._save(df, key, {})

    def _save(self, df: DataFrame, key: str, options: dict[str, str]) -> HashLayout:
        # dealt like the buckets, so that each bucket is one file and not one per task
        dealt = df.repartition(self.buckets, df[f"`{key}`"])
        place = {"path": self.path} if self.path else {}
        dealt.write.mode("overwrite").options(**options, **place).bucketBy(self.buckets, key).sortBy(key).format("parquet").saveAsTable(self.name)
        self.spark, self.column = df.sparkSession, key
        if self.path:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            self.spark.createDataFrame([(key, self.buckets, columns)], "key string, buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{self.path}_layout")
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str | None = None) -> HashLayout:
        """A layout that was built at the path before, as a table of this session."""
        out = cls(name=name, path=path)
        key, out.buckets, columns = spark.read.schema("key string, buckets int, columns string").json(f"{out.path}_layout").first()
        spark.sql(f"CREATE TABLE `{out.name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {out.buckets} BUCKETS LOCATION '{out.path}'")
        out.spark, out.column = spark, key
        return out

    def table(self) -> DataFrame:
        self._built()
        return self.spark.table(self.name)


class AdaptiveHashLayout(HashLayout):
    def __init__(self, capacity: int = 1_000_000, name: str | None = None, path: str | None = None) -> None:
        super().__init__(2, name, path)
        self.capacity = capacity

    def build(self, df: DataFrame, column: int | str) -> HashLayout:
        key = df.columns[place_of(df.columns, column)]
        rows, self.buckets = df.count(), 2
        while self.buckets * self.capacity < rows and self.buckets < 1 << 16:
            self.buckets *= 2
        return self._save(df, key, {f"parquet.bloom.filter.enabled#{key}": "true"})


class RangeLayout(_Ranges, Layout):
    def __init__(self, path: str, files: int | None = None, block_bytes: int = 16 << 20) -> None:
        super().__init__()
        self.path, self.files, self.block_bytes = path, files, block_bytes

    def build(self, df: DataFrame, column: int | str) -> RangeLayout:
        key = df.columns[place_of(df.columns, column)]
        cut = df.repartitionByRange(self.files, key) if self.files else df.repartitionByRange(key)
        cut.sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", self.block_bytes).parquet(self.path)
        self.spark, self.column = df.sparkSession, key
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, column: str) -> RangeLayout:
        """A layout that was built before."""
        out = cls(path)
        out.spark, out.column = spark, column
        return out

    def table(self) -> DataFrame:
        self._built()
        return self.spark.read.parquet(self.path)


class BlockIndex(_Ranges, Layout):
    """Over a Parquet table as it lies: key -> blocks of block_size rows of a file.

    A search looks the files up in the side table, which is sorted by key, and reads these files only, with
    the comparison pushed down to their row groups; rows are checked again. More than FILES files are not listed: then the
    whole table is scanned with the comparison pushed down.
    """

    FILES = 10_000

    def __init__(self, data: str, path: str, block_size: int = 1024) -> None:
        super().__init__()
        self.data, self.path, self.block_size = data, path, block_size

    def build(self, df: DataFrame, column: int | str) -> BlockIndex:
        """df gives the session and the column's name; the entries come from the table at data."""
        self.spark = df.sparkSession
        key = df.columns[place_of(df.columns, column)]
        block = F.floor(F.col("_metadata.row_index") / self.block_size)
        entries = self.spark.read.parquet(self.data).select(F.col(f"`{key}`").alias("key"), F.col("_metadata.file_path").alias("file"), block.alias("block")).distinct()
        entries.repartitionByRange("key").sortWithinPartitions("key", "file", "block").write.mode("overwrite").parquet(self.path)
        self.column = key
        return self

    @classmethod
    def open(cls, spark: SparkSession, data: str, path: str, column: str, block_size: int = 1024) -> BlockIndex:
        """An index that was built before."""
        out = cls(data, path, block_size)
        out.spark, out.column = spark, column
        return out

    def table(self) -> DataFrame:
        self._built()
        return self.spark.read.parquet(self.data)

    def entries(self) -> DataFrame:
        """The side table: key, file, block, in order of key."""
        self._built()
        return self.spark.read.parquet(self.path)

    def scan_range(self, start: int, stop: int) -> DataFrame:
        """The entries at places [start, stop) in order of key."""
        return rows_between(self.entries(), start, stop)

    def get_entry(self, place: int) -> DataFrame:
        return self.scan_range(place, place + 1)

    def _among(self, condition: Callable[[Column], Column]) -> DataFrame:
        """The rows of the files with an entry that meets the condition, checked again."""
        entries = self.entries()
        files = [r.file for r in entries.filter(condition(entries["key"])).select("file").distinct().limit(self.FILES + 1).collect()]
        whole = self.table()
        rows = self.spark.read.schema(whole.schema).parquet(*files) if 0 < len(files) <= self.FILES else whole if files else whole.limit(0)
        return rows.filter(condition(rows[f"`{self.column}`"]))

    def search(self, value: object) -> DataFrame:
        return self._among(lambda key: key == self._value(value))

    def range_search(self, low: object, high: object, open_low: bool = False, open_high: bool = False) -> DataFrame:
        def within(key: Column) -> Column:
            met = key.isNotNull()
            if low is not None:
                met = met & (key > self._value(low) if open_low else key >= self._value(low))
            if high is not None:
                met = met & (key < self._value(high) if open_high else key <= self._value(high))
            return met

        return self._among(within)


def index_join(left: DataFrame, layout: Layout, column: int | str) -> DataFrame:
    """Inner equi-join of left with the layout's table on its key; a HashLayout's side needs no exchange."""
    from relspark.operators.relational import join

    return join(left, layout.table(), (column, layout._built()))
