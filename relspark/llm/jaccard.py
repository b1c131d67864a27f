"""N-gram Jaccard join by MinHash banding.

1. Each document's set of five-word shingles (words: ASCII letters in lower case, digits and all that is
   not ASCII) gets a 128-bit fingerprint, BANDS x ROWS MinHash values as band hashes, and a sketch: a byte of each value.
   Documents of equal sets are one class; from here on only classes are joined, so exact copies are never paired.
2. Band and row counts are chosen for the target recall: a pair at the threshold agrees in at least AGREE
   bands with that probability (choose_bands), and in enough bytes of the sketch with that probability (least_alike).
3. Classes are shuffled on their band hashes. In a bucket of at most LOCAL classes every two that are not yet connected are
   compared by their sketches, in one task of bounded size. A larger bucket links its members to its least member where the
   sketches are alike; if its members are then not all connected, it is split by each further band, and its parts
   are handled in the same way; parts that are still larger after AGREE bands are linked whole. So any two classes that
   agree in AGREE bands and whose sketches are alike are connected, whatever else is in their buckets, and no
   bucket's pairs leave a task. The connected components are the candidate groups.
4. Every pair within a candidate group is verified on the full sets. A large group is dealt into blocks of about
   BLOCK shingles and each pair of blocks is a task; intersections are counted through posting lists, and only
   each class's number of links and a spanning forest of the links leave the task, not the pairs.
5. Connected components of the verified links give the class id. A group of one block is finished in its task; only
   the forests of groups of several blocks go through the iteration.

Defined results: a text of one to four words has one shingle, all its words; a text without words (null,
empty) is in no class with others and has no links. Repeated rows are copies of one another. A null doc_id
is kept, and is a class id only if its class has no other. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.llm.components import components
from relspark.shared import shared_folder

SHINGLE, THRESHOLD, RECALL, AGREE, BLOCK, LOCAL = 5, 0.8, 0.9999, 3, 100_000, 4096


def recall(similarity: float, rows: int, bands: int, agree: int = AGREE) -> float:
    """The probability that a pair of that similarity agrees in at least so many bands."""
    p = similarity**rows
    return 1 - sum(comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(agree))


@lru_cache
def choose_bands(threshold: float = THRESHOLD, target: float = RECALL, agree: int = AGREE, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows, and with them the fewest bands, that reach the target with at most so many values."""
    for rows in range(16, 0, -1):
        for bands in range(agree, most // rows + 1):
            if recall(threshold, rows, bands, agree) >= target:
                return bands, rows
    raise ValueError("no banding reaches the target recall")


def least_alike(values: int, threshold: float = THRESHOLD, target: float = RECALL) -> int:
    """The most bytes in which the sketches of a pair at the threshold agree with the target's probability or more."""
    missed, least = 0.0, 0
    while (missed := missed + comb(values, least) * threshold**least * (1 - threshold) ** (values - least)) <= 1 - target:
        least += 1
    return least


def _signatures(sets: np.ndarray, row: np.ndarray, rows: int, bands: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (rows x bands) and sketches (rows x values) of the shingle sets; 0 for an empty set."""
    rng = np.random.default_rng(7)
    flip, times = rng.integers(0, 1 << 63, (2, bands * depth), dtype=np.uint64)
    start = tk.row_bounds(row, rows)
    full = np.flatnonzero(np.diff(start))
    out, sketch = np.zeros((rows, bands), np.uint64), np.zeros((rows, bands * depth), np.uint8)
    for b in range(bands):
        total = np.full(len(full), b + 1, np.uint64)
        for k in range(b * depth, b * depth + depth):
            least = np.minimum.reduceat((sets ^ flip[k]) * (times[k] * np.uint64(2) + np.uint64(1)), start[full]) if len(full) else total
            total = tk.mix(total ^ least)
            sketch[full, k] = tk.mix(least) & np.uint64(0xFF)
        out[full, b] = total
    return out, sketch


def _prints(sets: np.ndarray, row: np.ndarray, rows: int) -> list[bytes | None]:
    """A 128-bit fingerprint of each set: two sums over differently mixed shingles; None for an empty set."""
    start = tk.row_bounds(row, rows)
    halves = []
    for salt in (np.uint64(0x1B873593), np.uint64(0xCC9E2D51)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(sets ^ salt), dtype=np.uint64)])
        halves.append(tk.mix(total[start[1:]] - total[start[:-1]]))
    both = np.stack(halves, 1).astype(">u8")
    return [both[k].tobytes() if n else None for k, n in enumerate(np.diff(start))]


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, row = tk.word_hashes(tk.lower(data), offsets, tk.PLAIN)
    return tk.shingles(words, row, len(offsets) - 1, k)


def _sign(source: Iterator[pa.RecordBatch], k: int, bands: int, depth: int) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        rows = len(offsets) - 1
        sets, row = _sets(data, offsets, k)
        tags, sketch = _signatures(sets, row, rows, bands, depth)
        tags = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(tags.view(np.int64).ravel()))
        columns = [part.column("doc_id"), part.column("th"), pa.array(_prints(sets, row, rows), pa.binary()), pa.array(np.bincount(row, minlength=rows)), tags]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "th", "fp", "n", "tags", "sketch"])


def _connected(source: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key, fp: in each bucket every member reached by alike sketches is linked to the least such member."""

    def close(fps: list[bytes], sketches: list[bytes]) -> None:
        marks = np.frombuffer(b"".join(sketches), np.uint8).reshape(max(len(fps), 1), -1)
        left = np.arange(len(fps))
        while len(left) > 1:
            head, left = left[0], left[1:]
            open_ = [head]
            while open_ and len(left):
                alike = np.count_nonzero(marks[left] == marks[open_.pop()], axis=1) >= least
                open_ += left[alike].tolist()
                out.extend((fps[k], fps[head]) for k in left[alike])
                left = left[~alike]

    out: list[tuple[bytes, bytes]] = []
    key, fps, sketches = None, [], []
    for part in source:
        for k, fp, sketch in zip(*(part.column(c).to_pylist() for c in ("key", "fp", "sketch")), strict=True):
            if k != key:
                close(fps, sketches)
                key, fps, sketches = k, [], []
            fps.append(fp)
            sketches.append(sketch)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["fp", "head"])
            out = []
    close(fps, sketches)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["fp", "head"])


def _alike(source: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows whose two sketches are alike."""
    for part in source:
        a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("sketch", "head_sketch"))
        yield part.select(["fp", "head"]).filter(pa.array(np.count_nonzero(a == b, axis=1) >= least))


def _collect_sets(source: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose fingerprint is the one asked for."""
    for part, data, offsets in tk.batches(source):
        rows = len(offsets) - 1
        sets, row = _sets(data, offsets, k)
        start = tk.row_bounds(row, rows)
        own = pa.array(_prints(sets, row, rows), pa.binary())
        column = pa.array([sets[start[i] : start[i + 1]].tobytes() for i in range(rows)], pa.binary())
        held = [(x == y) and x is not None for x, y in zip(own.to_pylist(), part.column("fp").to_pylist(), strict=True)]
        names = ["comp", "blocks", "fp", "copies", "rep"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), column], [*names, "grams"]).filter(pa.array(held, pa.bool_()))


def links_in(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Copies linked to each set, and a root for each set in the forest of links. side: 0 all pairs; 1 and 2 only pairs of a 1 with a 2."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    of = np.repeat(np.arange(m), size)
    grams, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    holders = of[order]
    at = np.searchsorted(which[order], np.arange(len(grams) + 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    linked, root = np.zeros(m, np.int64), np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(m):
        mine = which[begin[i] : begin[i + 1]]
        times = at[mine + 1] - at[mine]
        mine, times = mine[times > 1], times[times > 1]
        if not len(mine):
            continue
        slot = np.repeat(at[mine] - np.cumsum(times) + times, times) + np.arange(times.sum())
        common = np.bincount(holders[slot], minlength=m)
        common[: i + 1] = 0
        near = np.flatnonzero(common)
        near = near[(side[near] == 0) | (side[near] != side[i])]
        both = common[near]
        near = near[both >= threshold * (size[i] + size[near] - both) - 1e-9]
        linked[i] += copies[near].sum()
        linked[near] += copies[i]
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return linked, np.array([find(i) for i in range(m)], np.int64)


def _verify(source: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by comp, low, high; each such group is a task of one block or a pair of blocks.

    whole: the block is all of its group, so root and class_id (the least rep under a root) are final.
    """
    names = ["fp", "root", "linked", "rep", "class_id", "whole"]

    def close(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({x[4]: x for x in rows}.values())  # one row for each class
        if len(rows) < 2:
            return None
        low, high = rows[0][1], rows[0][2]
        side = np.array([0 if low == high else 1 if x[3] == low else 2 for x in rows])
        linked, root = links_in([np.frombuffer(x[6], np.uint64) for x in rows], np.array([x[5] for x in rows], np.int64), side, threshold)
        some = np.flatnonzero(linked)
        least: dict[int, int] = {}
        for k in some:
            if rows[k][7] is not None:
                least[root[k]] = min(least.get(root[k], rows[k][7]), rows[k][7])
        columns = [pa.array([rows[k][4] for k in some], pa.binary()), pa.array([rows[root[k]][4] for k in some], pa.binary()), pa.array(linked[some])]
        columns += [pa.array([rows[k][7] for k in some], pa.int64()), pa.array([least.get(root[k]) for k in some], pa.int64()), pa.array([rows[k][8] == 1 for k in some], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names)

    held: list[tuple] = []
    for part in source:
        for x in zip(*(part.column(c).to_pylist() for c in ("comp", "low", "high", "block", "fp", "copies", "grams", "rep", "blocks")), strict=True):
            if held and held[0][:3] != x[:3]:
                if out := close(held):
                    yield out
                held = []
            held.append(x)
    if held and (out := close(held)):
        yield out


def candidates(classes: DataFrame, bands: int, least: int, local: int = LOCAL) -> DataFrame:
    """Links fp, head that connect any two classes of a common bucket with alike sketches. classes: fp, tags, sketch.

    A round takes the buckets of one level: small ones in a task each, large ones by their head; only large ones that
    links don't connect go on to the next, each split by the bands after its last. There are at most AGREE rounds.
    """
    sketches, links, pair = classes.select("fp", "sketch"), None, "fp binary, head binary"
    rows = classes.select("fp", F.explode("tags").alias("band")).select(F.col("band").alias("key"), "band", "fp")
    for level in range(AGREE):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("fp").alias("head")).filter("size > 1").checkpoint()
        small = rows.join(sizes.filter(F.col("size") <= local).select("key"), "key").join(sketches, "fp").select("key", "fp", "sketch")
        # dealt by a hash of the key: by the key itself, Spark may take the exchange for done by the join before, and read that one unshuffled
        found = small.repartition(F.xxhash64("key", F.lit(level))).sortWithinPartitions("key", "fp").mapInArrow(partial(_connected, least=least), pair)
        links = (found if links is None else links.union(found)).distinct().checkpoint()
        large = sizes.filter(F.col("size") > local).select("key", "head")
        if large.isEmpty():
            break
        rows = rows.join(large, "key").checkpoint()
        stars = rows.filter("fp != head").select("fp", "head").distinct()
        if level + 1 < AGREE:
            stars = stars.join(sketches, "fp").join(sketches.select(F.col("fp").alias("head"), F.col("sketch").alias("head_sketch")), "head")
            stars = stars.mapInArrow(partial(_alike, least=least), pair)
        links = links.union(stars).distinct().checkpoint()
        # equal labels are told by their hash: a long is cheaper to compare than bytes
        labels = components(links, "fp", "head").select(F.col("v").alias("fp"), F.xxhash64("label").alias("label"))
        told = rows.join(labels, "fp", "left").select("key", F.coalesce("label", F.xxhash64("fp")).alias("label"))
        mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
        later = F.expr(f"slice(tags, cast(array_position(tags, band) as int) + 1, {bands})")
        rows = rows.join(mixed, "key").join(classes.select("fp", "tags"), "fp").select("key", "fp", F.explode(later).alias("band"))
        rows = rows.select(F.xxhash64("key", "band").alias("key"), "band", "fp").checkpoint()
    return links


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, shingle: int = SHINGLE, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """doc_id, th (the text's hash), class_id (least doc_id of all that links connect), n_links (documents linked), label (of the class; null without words)."""
    shared_folder(docs.sparkSession)
    bands, depth = choose_bands(threshold, target)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    schema = "doc_id long, th long, fp binary, n long, tags array<bigint>, sketch binary"
    signed = slim.mapInArrow(partial(_sign, k=shingle, bands=bands, depth=depth), schema).checkpoint()
    worded = signed.filter("fp is not null")
    kept = [F.first(c).alias(c) for c in ("tags", "sketch")]
    classes = worded.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), *kept).checkpoint()

    links = candidates(classes.select("fp", "tags", "sketch"), bands, least_alike(bands * depth, threshold, target), local)
    groups = components(links, "fp", "head").withColumnRenamed("v", "fp")
    groups = groups.withColumnRenamed("label", "comp")

    members = groups.join(classes.drop("tags", "sketch"), "fp")
    load = members.groupBy("comp").agg(F.sum("n").alias("load")).select("comp", F.expr(f"cast(ceil(load / {block}) as int)").alias("blocks"))
    wanted = members.join(load, "comp").select("comp", "blocks", "fp", "copies", "rep")
    texts = slim.join(wanted, slim.doc_id.eqNullSafe(wanted.rep)).select("comp", "blocks", "fp", "copies", "rep", "text")
    schema = "comp binary, blocks int, fp binary, copies long, rep long, grams binary"
    sets = texts.mapInArrow(partial(_collect_sets, k=shingle), schema).withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    dealt = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "copies", "grams", "rep", "blocks")
    dealt = dealt.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    schema = "fp binary, root binary, linked long, rep long, class_id long, whole boolean"
    verified = dealt.mapInArrow(partial(_verify, threshold=threshold), schema).checkpoint()

    linked = verified.filter("whole").select("fp", "linked", "class_id", F.col("root").alias("label"))
    rest = verified.filter("not whole")
    if not rest.isEmpty():
        connected = components(rest.select("fp", "root"), "fp", "root").withColumnRenamed("v", "fp")
        counted = rest.groupBy("fp").agg(F.sum("linked").alias("linked"), F.first("rep").alias("rep")).join(connected, "fp").checkpoint()
        # written tables on both sides, so that Spark can split a class of many texts
        least = counted.groupBy("label").agg(F.min("rep").alias("class_id")).checkpoint()
        linked = linked.union(counted.join(least, "label").select("fp", "linked", "class_id", "label"))
    named = classes.select("fp", "rep", "copies").join(linked, "fp", "left")
    named = named.select("fp", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    # written, so that both sides are shuffled and Spark can split the rows of a much-copied text
    named = named.checkpoint()
    out = signed.select("doc_id", "th", "fp").join(named, "fp", "left")
    own = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "th", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "label")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """One document of each class, that of the least doc_id (null first; among equal ones that of the least text hash); documents without words all stay."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    found = join(docs, threshold, target).filter("label is not null")
    chosen = found.groupBy("label").agg(F.min(F.struct(number("doc_id").alias("__id"), F.col("th").alias("__th"))).alias("one")).select("one.*")
    one = docs.withColumns({"__id": number("doc_id"), "__th": F.xxhash64("text")}).join(chosen, ["__id", "__th"])
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return one.dropDuplicates(["__id", "__th"]).select(docs.columns).unionByName(docs.filter(blank))
