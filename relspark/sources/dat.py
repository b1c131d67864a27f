"""Fixed-width binary integer tables ("dat") as a Spark data source.

A file is a header of two unsigned 32-bit ints (rows, columns) and the rows, each as many signed 32-bit ints;
little-endian. Columns are A1, A2, ... A path is a file or a folder of such files, local (shared by all
executors) or an URI that pyarrow's file systems know. Files are read in ranges of rows, one task each; options firstRow and
rows read only so many rows from a place on (files in order of name). A write
makes a folder with one file per task, so no data passes through the driver, and a frame of one partition gives one file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, IntegerType, ShortType, StructField, StructType

HEADER = struct.Struct("<II")
SPLIT_BYTES, BATCH_ROWS = 32 << 20, 1 << 16


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, rows, columns) of the files at path. FileNotFoundError if there is none, ValueError for a bad header."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info]
    if info.type == fs.FileType.Directory:
        found = sorted((x for x in store.get_file_info(fs.FileSelector(base)) if x.is_file and x.base_name.endswith(".dat") and x.base_name[0] not in "._"), key=lambda x: x.base_name)
        if not found:
            raise FileNotFoundError(f"no .dat file in {path}")
    out = []
    for x in found:
        with store.open_input_stream(x.path, compression=None) as f:
            head = f.read(HEADER.size)
        if len(head) != HEADER.size:
            raise ValueError(f"{x.path}: the header is too short")
        rows, columns = HEADER.unpack(head)
        if x.size < HEADER.size + 4 * rows * columns:
            raise ValueError(f"{x.path}: {rows} rows of {columns} columns don't fit in {x.size} bytes")
        out.append((x.path, rows, columns))
    return out


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    rows: int
    columns: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int, first: int, rows: int | None) -> None:
        self.path, self.schema, self.split_bytes, self.first, self.stop = path, schema, split_bytes, first, None if rows is None else first + rows

    def partitions(self) -> list[_Rows]:
        out, before = [], 0
        for path, rows, columns in _files(self.path):
            step = max(1, self.split_bytes // (4 * max(columns, 1)))
            low, high = max(0, self.first - before), rows if self.stop is None else min(rows, self.stop - before)
            out += [_Rows(path, k, min(step, high - k), columns) for k in range(low, high, step)]
            before += rows
        return out or [_Rows("", 0, 0, 0)]

    def read(self, partition: _Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        if not partition.rows:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        width = 4 * partition.columns
        with store.open_input_file(partition.path) as f:
            f.seek(HEADER.size + partition.first * width)
            for k in range(0, partition.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.rows - k)
                block = np.frombuffer(f.read(n * width), "<i4").reshape(n, partition.columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(block[:, c])) for c in range(partition.columns)], self.schema.names)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        bad = [f.name for f in schema.fields if not isinstance(f.dataType, IntegerType | ShortType | ByteType)]
        if bad:
            raise ValueError(f"only 32-bit ints can be written; cast {', '.join(bad)}")
        self.path, self.overwrite, self.columns, self.run = path, overwrite, len(schema.fields), uuid.uuid4().hex[:8]

    def _store(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> _Written:
        import numpy as np
        from pyspark import TaskContext

        store, base = self._store()
        context = TaskContext.get()
        store.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():05d}-{self.run}.dat"
        temporary, n = f"{base}/_{name}.{context.taskAttemptId()}", 0
        # the header's count is known at the end: the rows go to a file of their own first, a batch at a time
        with store.open_output_stream(f"{temporary}.rows", compression=None) as out:
            for batch in iterator:
                if any(column.null_count for column in batch.columns):
                    raise ValueError("a dat file has no nulls")
                block = np.empty((batch.num_rows, self.columns), "<i4")
                for k, column in enumerate(batch.columns):
                    block[:, k] = column.to_numpy(zero_copy_only=False)
                out.write(block.tobytes())
                n += batch.num_rows
        with store.open_input_stream(f"{temporary}.rows", compression=None) as rows, store.open_output_stream(temporary, compression=None) as out:
            out.write(HEADER.pack(n, self.columns))
            while part := rows.read(1 << 20):
                out.write(part)
        store.delete_file(f"{temporary}.rows")
        return _Written(temporary, f"{base}/{name}")

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, base = self._store()
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if x.is_file and x.base_name.endswith(".dat"):
                    store.delete_file(x.path)
        for m in messages:
            if m is not None:
                store.move(m.path, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = self._store()
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class DatSource(DataSource):
    """spark.read.format("dat").load(path); df.write.format("dat").mode("append" or "overwrite").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "dat"

    def schema(self) -> StructType:
        columns = {c for _, _, c in _files(self.options["path"])}
        if len(columns) != 1:
            raise ValueError(f"files of {sorted(columns)} columns in one table")
        return StructType([StructField(f"A{k + 1}", IntegerType(), False) for k in range(columns.pop())])

    def reader(self, schema: StructType) -> _Reader:
        rows = self.options.get("rows")
        return _Reader(self.options["path"], schema, int(self.options.get("splitbytes", SPLIT_BYTES)), int(self.options.get("firstrow", 0)), None if rows is None else int(rows))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatSource)
