"""WARC archives: a deterministic sharded writer with revisit records, and a reader.

Writing: page ids are cut into ranges of about equal payload bytes; the cuts come from exact sums over bins of
ids (bins that are too heavy are cut finer), so shards don't depend on partitioning. A single id, or the null id, that is too
heavy for a shard is split by digest and url, and a row that is repeated too often by its copies. Records are dealt by shard
and sorted by page id. Each task writes its shards' records as gzip members with headers and digests made anew,
and begins a new file once a file has ROLL compressed bytes. Files are written under temporary names that
hold the task attempt; the attempts that Spark accepts are listed in a table, their files are renamed to
final names, and the manifest is written last; then temporary files, those of failed attempts among them, are removed.
A lost executor's files are never listed. Names, order and bytes are the same in every run.

Of records with equal payloads of at least LEAST bytes that of the smallest page id is a response and the others
revisit it. Who revisits whom is found on digests alone; the payloads are shuffled once.

Files are opened through pyarrow's file systems (local or shared folders and the object stores and HDFS that it
knows), records are read as a stream. Defined results: a null html has the empty payload; a null page id comes
last and is referred to by none but null (a group without any id refers to null); of rows with one page id
and payload the first by url (null first) is the response; of rows equal in all three one is; a null url is left out of the
headers; an empty table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.shared import shared_folder

LEAST, ROLL, DATE = 100, 64 << 20, "2024-01-01T00:00:00Z"
BINS, FINER = 4096, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, part int, path string, n_records long, n_bytes long, sha256 string"


def _record_id(page_id: int | None, url: str | None, digest: str, k: int) -> str:
    name = f"{page_id}:{digest}:{k}:{'' if url is None else '=' + url}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, k: int, revisit: bool, refers: int | None, refers_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _record_id(page_id, url, digest, k)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    headers += [("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url))] if url else []
    headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if not revisit:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, refers_url, digest, 0))]
    headers += [("X-Refers-To-Page-Id", str(refers))] if refers is not None else []
    return _record("revisit", headers, http)


class _File:
    """An archive under its temporary name."""

    def __init__(self, root: str, shard: int, part: int) -> None:
        self.store, base = fs.FileSystem.from_uri(root)
        self.shard, self.part, self.n = shard, part, 0
        self.path = f"_temporary/{shard:06d}-{part:04d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        self.store.create_dir(f"{base}/_temporary", recursive=True)
        self.out, self.size, self.digest = self.store.open_output_stream(f"{base}/{self.path}", compression=None), 0, hashlib.sha256()
        name = f"{shard:06d}-{part:04d}.warc.gz"
        info = f"software: relspark\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
        self.put(_record("warcinfo", [("WARC-Record-ID", _record_id(None, None, name, 0)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def row(self) -> pa.RecordBatch:
        self.out.close()
        values = [self.shard, self.part, self.path, self.n, self.size, self.digest.hexdigest()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["shard", "part", "path", "n_records", "n_bytes", "sha256"])


def _write(source: Iterator[pa.RecordBatch], root: str, roll: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, page id, digest, url; of equal ones a mark that the payload is a revisit comes first. A row of copy >= 0 stands for so many copies, from that number on."""
    file, last, seen, marked, refers = None, None, 0, False, (None, None)
    for part in source:
        columns = [part.column(c) for c in ("shard", "page_id", "url", "html", "digest", "mark", "first", "first_url", "copy", "copies")]
        for i in range(part.num_rows):
            shard, page_id, url, html, digest, mark, first, first_url, copy, copies = (c[i].as_py() for c in columns)
            if (shard, page_id, digest, url) != last:
                last, seen, marked, refers = (shard, page_id, digest, url), 0, False, (page_id, url)
            if mark:
                marked, refers = True, (first, first_url)
                continue
            if file and file.shard != shard:
                yield file.row()
                file = None
            payload = (html or "").encode()
            begin = copy if copy >= 0 else seen
            for k in range(begin, begin + copies):
                if file and file.size >= roll:
                    yield file.row()
                    file = _File(root, shard, file.part + 1)
                file = file or _File(root, shard, 0)
                file.put(_page_record(page_id, url, payload, digest, k, len(payload) >= least and (marked or k > 0), *refers))
                file.n += 1
            seen += copies
    if file:
        yield file.row()


def _commit(source: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Renames; a repeated attempt finds the final name there and is content."""
    store, base = fs.FileSystem.from_uri(root)
    for part in source:
        final = [f"{s:06d}-{p:04d}.warc.gz" for s, p in zip(part.column("shard").to_pylist(), part.column("part").to_pylist(), strict=True)]
        for old, new in zip(part.column("path").to_pylist(), final, strict=True):
            if store.get_file_info(f"{base}/{old}").type != fs.FileType.NotFound:
                store.move(f"{base}/{old}", f"{base}/{new}")
            elif store.get_file_info(f"{base}/{new}").type == fs.FileType.NotFound:
                raise FileNotFoundError(f"neither {old} nor {new}")
        yield part.set_column(part.schema.get_field_index("path"), "path", pa.array(final, pa.string()))


def _slot(edges: np.ndarray) -> Column:
    """The range of ids that a page id falls in; the null id has a range of its own after the last."""

    @F.pandas_udf("int")
    def slot(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32) - 1)

    return F.when(F.col("page_id").isNull(), F.lit(len(edges))).otherwise(slot(F.coalesce("page_id", F.lit(0))))


def _shards(slim: DataFrame, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ids of ranges, and of each range, and at last of the null id, the first shard and the number of shards that it is split into.

    At most BINS + FINER * total / target sums reach the driver at a time, whatever the ids.
    """
    low, high = slim.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    edges = sorted({low + (high - low + 1) * k // BINS for k in range(BINS)})
    while True:
        sums = [0] * (len(edges) + 1)
        for slot, n in slim.groupBy(_slot(np.array(edges, np.int64)).alias("slot")).agg(F.sum(F.col("n") + 500)).collect():
            sums[slot] = n
        following = [*edges[1:], high + 1]
        heavy = [k for k, e in enumerate(edges) if sums[k] > target and following[k] - e > 1]
        if not heavy:
            break
        edges = sorted({*edges, *(edges[k] + (following[k] - edges[k]) * j // FINER for k in heavy for j in range(FINER))})
    first, parts, load, shard = [], [], 0, 0
    for n in sums:
        split = -(-n // target) if n > target else 1
        if load and (load + n > target or split > 1):
            shard, load = shard + 1, 0
        first.append(shard)
        parts.append(split)
        load += n
        if split > 1:
            shard, load = shard + split, 0
    return np.array(edges, np.int64), np.array(first), np.array(parts)


def _dealt(edges: np.ndarray, first: np.ndarray, parts: np.ndarray) -> Column:
    """A row's shard."""

    @F.pandas_udf("int")
    def shard(slots, hashes):  # noqa: ANN001, ANN202
        import pandas as pd

        k = slots.to_numpy(np.int64)
        return pd.Series((first[k] + hashes.to_numpy(np.int64) % parts[k]).astype(np.int32))

    return shard(_slot(edges), F.xxhash64("digest", "url", "copy"))


def write(pages: DataFrame, root: str, least: int = LEAST, roll: int = ROLL, shard_bytes: int | None = None) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) under root, an URI; gives the manifest, which is at root/_manifest."""
    spark = pages.sparkSession
    shared_folder(spark)
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256).alias("digest")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest)
    slim = rows.select("page_id", "url", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).checkpoint()
    total = slim.agg(F.sum(F.col("n") + 500)).first()[0] or 0
    target = shard_bytes or min(max(total // 2048, 1 << 20), 256 << 20)
    last = F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1))  # null comes last; it yields to the same number by the next field
    groups = slim.filter(F.col("n") >= least).groupBy("digest").agg(F.min(F.struct(last.alias("at"), F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("one"), F.count("*").alias("held"))
    groups = groups.filter("held > 1").select("digest", F.col("one.page_id").alias("first"), F.col("one.url").alias("first_url")).checkpoint()
    marks = slim.filter(F.col("n") >= least).join(groups, "digest").filter("not (page_id <=> first and url <=> first_url)")
    marks = marks.select("page_id", "url", "digest", "first", "first_url").distinct()
    edges, first, parts = _shards(slim, target)
    key = ["page_id", "url", "digest"]
    plain = lambda x: x.select(*key, "html", F.lit(-1).cast("long").alias("copy"), F.lit(1).cast("long").alias("copies"))
    dealt, noted = plain(rows), marks.withColumn("copy", F.lit(-1).cast("long"))
    if (parts > 1).any():  # an id is too heavy for a shard; perhaps a row is
        # rows repeated beyond a shard's bytes: at most total / target, so their table has a bound; one of each is kept, for ranges of copies
        often = slim.groupBy(key).agg(F.count("*").alias("held"), F.sum(F.col("n") + 500).alias("bytes")).filter(F.col("bytes") > target)
        often = often.select(*[F.col(c).alias(f"o_{c}") for c in key], "held", F.expr(f"cast(least(held, ceil(bytes / {target})) as int)").alias("ranges")).checkpoint()
        same = F.expr("page_id <=> o_page_id and url <=> o_url and digest = o_digest")
        begin = lambda r: f"cast(held as bigint) * ({r}) div ranges"
        held = rows.join(F.broadcast(often), same).dropDuplicates(key).withColumn("r", F.explode(F.expr("sequence(0, ranges - 1)")))
        ranges = held.select(*key, "html", F.expr(begin("r")).alias("copy"), F.expr(f"{begin('r + 1')} - {begin('r')}").alias("copies"))
        dealt = plain(rows.join(F.broadcast(often), same, "left_anti")).union(ranges)
        # a mark goes to every shard of its row's copies
        ranged = noted.drop("copy").join(F.broadcast(often), same, "left").withColumn("r", F.explode(F.expr("sequence(0, coalesce(ranges, 1) - 1)")))
        noted = ranged.withColumn("copy", F.expr(f"coalesce({begin('r')}, -1L)"))
    blank = F.lit(None).cast("string")
    both = dealt.select(*key, "html", "copy", "copies", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("first"), blank.alias("first_url"))
    both = both.union(noted.select(*key, blank, "copy", F.lit(0).cast("long"), F.lit(1), "first", "first_url"))
    dealt = both.withColumn("shard", _dealt(edges, first, parts)).repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "url", F.col("mark").desc(), "copy")
    dealt.mapInArrow(partial(_write, root=root, roll=roll, least=least), _MANIFEST).write.parquet(f"{root}/_attempts")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.schema(_MANIFEST).parquet(f"{root}/_attempts").repartition(wide, "shard", "part")
    listed.mapInArrow(partial(_commit, root=root), _MANIFEST).write.parquet(f"{root}/_manifest")
    store, base = fs.FileSystem.from_uri(root)
    for name in ("_temporary", "_attempts"):
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{name}")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    """The gzip members of a stream, unpacked, one at a time."""
    unpacker, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(step)
        if not data:
            break
        out.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, its block digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if not lines[0].startswith("WARC/1.") or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["warc-block-digest"]:
        raise ValueError(f"a damaged record: {lines[:4]}")
    return headers, block


def _read(source: Iterator[pa.RecordBatch], root: str, payload: bool) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(root)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payload
    for part in source:
        for path in part.column("path").to_pylist():
            rows, size = [], 0
            with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                for record in members(stream):
                    headers, block = parse(record)
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"a damaged payload in {path}")
                    number = lambda name, h=headers: int(h[name]) if name in h else None
                    rows.append((number("x-page-id"), headers.get("warc-target-uri"), n, digest, kind, number("x-refers-to-page-id"), path, body)[: len(names)])
                    size += len(body) if payload else 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists, digests checked; a revisit's payload is empty."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string" + ", payload binary" * payload
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest").repartition(wide, "path")
    return listed.mapInArrow(partial(_read, root=root, payload=payload), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages in a new folder of the cluster's shared folder and reads them back."""
    spark = pages.sparkSession
    root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, root)
    return read(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
