"""Line dedup by pairwise alignment.

A line is what stands between line feeds, white space at its ends removed; blank lines are passed over. The copies
looked for are blocks: consecutive lines of together at least MIN_BLOCK_WORDS words that also stand, consecutive, in an
earlier document. Documents are in order of doc_id, null first, then of the text's hash.

1. Lines are counted over the corpus. A line that one document alone holds is in no common block; what is left of a
   document are stretches of shared lines.
2. Within the stretches, the shortest runs of lines that reach MIN_BLOCK_WORDS words, forward from each line and
   backward from each line, cover every block. A run is found through its rarest line: runs meet on that line's hash and
   their own, so common lines bring documents together only as part of a run that is common as a whole.
3. Each run links its holders to its first holder: one link for each occurrence, at most two for each line, whatever the
   number of holders; holders are never paired with one another. A link carries the run's places in both documents, so a
   pair is aligned on the lines it shares and on nothing else.
4. Each linked pair is aligned by patience diff: runs found once in both anchor it, and its longest increasing
   chain of places in both documents is the alignment. Runs that the diff leaves over are blocks that were moved or repeated;
   they are matched by themselves, and reported as moved.
5. The later document loses the lines of its blocks, and blank lines within them. The first holder of a line has no
   earlier holder of any run with it and keeps it, so no line is lost altogether.

A document is its doc_id and text. Defined results: rows with the same doc_id and text are one document (each keeps its
row and is treated alike); a null text stays null, an empty text stays empty; an empty table gives an
empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relspark.llm import textkit as tk
from relspark.shared import shared_folder

MIN_BLOCK_WORDS = 20
_FEED = np.zeros(256, bool)
_FEED[0x0A] = True
_WHITE = "\x20\t\n\x0b\x0c\r"


def _lines(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document with a line: two hashes and the number of words of each line that is not blank."""
    for part, data, offsets in tk.batches(source):
        s, e, row = tk.word_bounds(data, offsets, _FEED)
        first, last, _ = tk.word_bounds(data, offsets, tk.WHITE)
        a, b = np.searchsorted(first, s), np.searchsorted(first, e)
        there = b > a
        a, b, row = a[there], b[there], row[there]
        begin, end = first[a], last[b - 1]
        bounds = pa.array(tk.row_bounds(row, len(offsets) - 1).astype(np.int32))
        held = [tk.hash_spans(data, begin, end, table).view(np.int64) for table in tk.TABLES]
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (*held, (b - a).astype(np.int32))]
        out = pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), *lists], ["id", "th", "h", "g", "w"])
        yield out.filter(pa.array(np.diff(tk.row_bounds(row, len(offsets) - 1)) > 0))


def _slices(source: Iterator[pa.RecordBatch], least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes, or of one row."""
    for batch in source:
        step = max(1, batch.num_rows * least // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row and fields of all elements of a column of lists of structs."""
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), {f.name: inner.field(k) for k, f in enumerate(inner.type)}


def runs(row: np.ndarray, place: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest runs that reach so many words, from each line on and back from each line, each once.

    Lines are given in order of row (document) and place; a run's lines are in one document and have consecutive places.
    """
    n = len(row)
    broken = np.ones(n, bool)
    broken[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    stretch = np.cumsum(broken)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + least) - 1
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    first, last = np.concatenate([at, back]), np.concatenate([ahead, at])
    ok = (first >= 0) & (last < n)
    first, last = first[ok], last[ok]
    ok = stretch[first] == stretch[last]
    both = np.unique(first[ok] * n + last[ok]) if n else first
    return both // max(n, 1), both % max(n, 1)


def _runs(source: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The runs of each document's shared lines: rarest line, two hashes, first line and number of lines."""
    for part in _slices(source):
        row, x = _flat(part.column("shared"))
        place, words, seen = (x[c].to_numpy() for c in ("i", "w", "n"))
        h, g = (x[c].to_numpy().view(np.uint64) for c in ("h", "g"))
        order = np.lexsort((place, row))
        row, place, words, seen, h, g = (v[order] for v in (row, place, words, seen, h, g))
        first, last = runs(row, place, words, least)
        rare = first.copy()
        for k in range(1, int((last - first).max(initial=0)) + 1):
            at = np.minimum(first + k, last)
            less = (seen[at] < seen[rare]) | ((seen[at] == seen[rare]) & (h[at] < h[rare]))
            rare = np.where(less, at, rare)
        doc = pa.array(row[first])
        columns = [part.column("id").take(doc), part.column("th").take(doc), pa.array(h[rare].view(np.int64))]
        columns += [pa.array(tk.hash_runs(v, first, last + 1).view(np.int64)) for v in (h, g)]
        columns += [pa.array(place[first].astype(np.int32)), pa.array((last - first + 1).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "th", "rare", "r1", "r2", "start", "lines"])


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Numbers of the pairs of places (ascending in the first) that a patience diff aligns: anchors whose second place
    occurs once, of these a longest chain that ascends in both, and what fits between two of the chain."""
    once = Counter(j for _, j in pairs)
    anchors = [k for k, (_, j) in enumerate(pairs) if once[j] == 1]
    tails, at, back = [], [], {}
    for k in anchors:
        slot = bisect_left(tails, pairs[k][1])
        tails[slot : slot + 1], at[slot : slot + 1] = [pairs[k][1]], [k]
        back[k] = at[slot - 1] if slot else -1
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    chain.reverse()
    limit = {a: pairs[b][1] for a, b in zip(chain, chain[1:], strict=False)}
    kept, out, below, above = set(chain), [], -1, pairs[chain[0]][1] if chain else 1 << 62
    for k, (_, j) in enumerate(pairs):
        if k in kept:
            above = limit.get(k, 1 << 62)
        if k in kept or below < j < above:
            out.append(k)
            below = j
    return out


def _aligned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that each document loses, ascending, and how many of them are in moved blocks only."""
    for part in _slices(source, 1 << 18):
        cuts, moved = [], []
        for links in part.column("links").to_pylist():
            links = sorted({((x["id"] is not None, x["id"] or 0, x["th"]), x["start"], x["first_start"], x["lines"]) for x in links})
            mine, others, begin = set(), set(), 0
            for k in range(1, len(links) + 1):
                if k < len(links) and links[k][0] == links[begin][0]:
                    continue
                pair = links[begin:k]
                chosen = set(patience([(x[1], x[2]) for x in pair]))
                for n, (_, start, _, lines) in enumerate(pair):
                    (mine if n in chosen else others).update(range(start, start + lines))
                begin = k
            cuts.append(sorted(mine | others))
            moved.append(len(others - mine))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(cuts, pa.list_(pa.int32())), pa.array(moved, pa.int64())], ["id", "th", "cut", "moved"])


def cuts(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """id, th (doc_id and the text's hash), cut and moved of each document that loses lines: their numbers among its lines that are not blank."""
    shared_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").filter("text is not null")
    # 128 bits of hash for a line over the whole corpus
    sequences = texts.mapInArrow(_lines, "id long, th long, h array<bigint>, g array<bigint>, w array<int>").dropDuplicates(["id", "th"]).checkpoint()
    lines = sequences.select("id", "th", F.posexplode(F.arrays_zip("h", "g", "w")).alias("i", "x")).select("id", "th", "i", "x.h", "x.g", "x.w")
    # written tables, so that both sides of the joins below are shuffled and Spark can split a common line or run
    document = F.xxhash64("id", "th")
    held = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(document).alias("low"), F.max(document).alias("high")).filter("low != high").select("h", "g", "n").checkpoint()
    shared = lines.join(held, ["h", "g"]).groupBy("id", "th").agg(F.collect_list(F.struct("i", "h", "g", "w", "n")).alias("shared"))
    found = shared.mapInArrow(partial(_runs, least=min_block_words), "id long, th long, rare long, r1 long, r2 long, start int, lines int").checkpoint()
    run = ["rare", "r1", "r2"]
    ends = found.groupBy(run).agg(F.min(F.struct("id", "th", "start")).alias("first"), F.max(F.struct("id", "th")).alias("last"))
    ends = ends.filter("not (first.id <=> last.id and first.th = last.th)").select(*run, "first").checkpoint()
    links = found.join(ends, run).filter("not (id <=> first.id and th = first.th)")
    links = links.select("id", "th", F.struct("first.id", "first.th", "start", F.col("first.start").alias("first_start"), "lines").alias("link"))
    return links.groupBy("id", "th").agg(F.collect_list("link").alias("links")).mapInArrow(_aligned, "id long, th long, cut array<int>, moved long")


def erase(text: str, cut: list[int]) -> tuple[str, int]:
    """The text without its lines of these numbers (of lines that are not blank, ascending) and blank ones between two of consecutive numbers; the lines deleted."""
    lines, gone, k, out, blank = text.split("\n"), set(cut), -1, [], []
    for line in lines:
        if not line.strip(_WHITE):
            blank.append(line)
            continue
        k += 1
        if k not in gone or k - 1 not in gone:
            out += blank
        blank = []
        if k not in gone:
            out.append(line)
    out += blank
    return "\n".join(out), len(lines) - len(out)


def _erased(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in source:
        text, cut = part.column("text"), part.column("cut")
        where = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
        deleted, moved = np.zeros(part.num_rows, np.int64), part.column("moved").fill_null(0)
        if len(where):
            changed = [erase(text[int(k)].as_py(), cut[int(k)].as_py()) for k in where]
            deleted[where] = [n for _, n in changed]
            source_rows = np.arange(part.num_rows)
            source_rows[where] = part.num_rows + np.arange(len(where))
            text = pa.concat_arrays([text, pa.array([t for t, _ in changed], text.type)]).take(pa.array(source_rows))
        names = [c for c in part.schema.names if c not in ("cut", "moved")]
        columns = [text if c == "text" else part.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(deleted), moved], [*names, "n_deleted", "n_moved"])


def _work(docs: DataFrame, min_block_words: int) -> tuple[DataFrame, list]:
    """The documents with their cuts done, columns under private names c0, c1, ... but text, and n_deleted, n_moved; the columns by their own names."""
    names = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    found = cuts(docs, min_block_words)
    n_lines = F.expr(r"if(text is null or text = '', 0, size(split(text, '\n')))").cast("long").alias("n_lines")
    held = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)]).select("*", n_lines)
    key = f"c{docs.columns.index('doc_id')}"
    joined = held.join(found, held[key].cast("long").eqNullSafe(found["id"]) & (F.xxhash64(held["text"]) == found["th"]), "left").drop("id", "th")
    counts = [StructField("n_deleted", LongType()), StructField("n_moved", LongType())]
    out = joined.mapInArrow(_erased, StructType([*held.schema.fields, *counts]))
    return out, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def dedup(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """The documents without their common blocks, and n_lines (of the input), n_deleted, n_moved (lines) added; input columns of these three names are left out."""
    docs = docs.drop("n_lines", "n_deleted", "n_moved")
    out, own = _work(docs, min_block_words)
    return out.select(*own, "n_lines", "n_deleted", "n_moved")


def clean(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, length: str = "n_chars") -> DataFrame:
    """The documents of which something is left, with their columns only; a column of name length is counted anew where lines went."""
    out, own = _work(docs, min_block_words)
    out = out.filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if length in docs.columns:
        k = docs.columns.index(length)
        kind = docs.schema[length].dataType
        own[k] = F.when(F.col("n_deleted") > 0, F.length("text").cast(kind)).otherwise(F.col(f"c{k}")).alias(length)
    return out.select(*own)
