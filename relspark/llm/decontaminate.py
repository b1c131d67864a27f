"""Benchmark decontamination: prefix-filtered set join over item-sized windows.

A window is SPAN consecutive words of an item (all words of a shorter item). A window's tokens are its
shingles of two words (its word, if it has one). All shingles of the benchmark are counted over the whole
corpus and ordered by rarity. A document that contains a window contains every one of its tokens, so the
necessary prefix is one token, the rarest: documents are joined to windows on that token alone. Its place
in the window bounds where the window would begin; the window must lie within its document (length bound),
and then all words are compared.

The benchmark's size decides how that join runs, and the rows are the same either way. Up to LOCAL_BYTES of text, the windows
are one small table that goes to the tasks, and the documents stream past it. Beyond that, windows, counts and prefixes are tables:
tokens of the documents are counted in one pass and joined with those of the benchmark by a shuffle, then the places of
prefix tokens, each with the words around it, are joined with the windows by another. Before both shuffles a bit table of
2^FILTER_BITS bits, whatever the benchmark, leaves out tokens that it can't hold; only that table goes through the driver. The
documents' texts are never shuffled by report. Words are compared by 64-bit fingerprints.

Defined results: a null or empty text has no words; an empty benchmark hits nothing. A null item_id
counts as the empty string; rows of one item_id count as one item. Repeated documents each get their row.
Other columns are not looked at, and clean passes them on whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.shared import shared_folder

SPAN, LOCAL_BYTES, FILTER_BITS = 10, 1 << 20, 27
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _pad(words: np.ndarray, row: np.ndarray, rows: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's words (n x span, 0 where it is shorter), length and item row."""
    bounds = tk.row_bounds(row, rows)
    at = np.arange(len(words))
    at = at[at <= np.maximum(bounds[row], bounds[row + 1] - span)] if len(at) else at
    size = np.minimum(span, bounds[row[at] + 1] - at)
    table = np.zeros((len(at), span), np.uint64)
    for j in range(span):
        ok = j < size
        table[ok, j] = words[at[ok] + j]
    return table, size, row[at]


class Windows:
    """The distinct windows of a block of items, by vocabulary numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], span: int) -> None:
        column = pa.array([text for _, text in items], pa.string())
        data, offsets = tk.utf8(column)
        words, row = tk.word_hashes(tk.lower(data), offsets, tk.PLAIN)
        table, size, of = _pad(words, row, len(items), span)
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        item = np.array([number[name] for name, _ in items], np.int64)[of] if len(of) else np.zeros(0, np.int64)
        self.vocabulary = np.unique(words)
        ids = np.where(np.arange(span) < size[:, None], np.searchsorted(self.vocabulary, table), -1)
        self.words, which = np.unique(ids, axis=0, return_inverse=True) if len(ids) else (np.zeros((0, span), np.int64), np.zeros(0, np.int64))
        self.size = (self.words >= 0).sum(1)
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
        wide = len(self.vocabulary)
        left, right = self.words[:, :-1], self.words[:, 1:]
        self.codes = np.where(right >= 0, left * wide + right, -1)
        # a window of one word has its word as only token, coded below -1
        self.codes = np.concatenate([self.codes, np.where(self.size == 1, -2 - self.words[:, 0], -1)[:, None]], 1)
        self.tokens = np.unique(self.codes[self.codes != -1])
        self.short = bool((self.tokens < 0).any())

    def choose(self, counts: dict[int, int]) -> None:
        """Keep each window's rarest token, and where in the window it begins."""
        seen = np.array([counts.get(k, 0) for k in range(len(self.tokens))], np.int64)
        often = np.where(self.codes != -1, seen[np.searchsorted(self.tokens, self.codes).clip(0, max(len(self.tokens) - 1, 0))] if len(self.tokens) else 0, np.iinfo(np.int64).max)
        best = often.argmin(1) if len(often) else np.zeros(0, np.int64)
        token = self.codes[np.arange(len(best)), best]
        order = np.argsort(token, kind="stable")
        self.window, self.shift = order, np.where(token < 0, 0, best)[order]
        self.prefix, first = np.unique(token[order], return_index=True)
        self.prefix_at = np.append(first, len(order))
        self.codes = None


def _numbered(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number (-1: none) and row of each word."""
    words, row = tk.word_hashes(tk.lower(data), offsets, tk.PLAIN)
    if not len(vocabulary):
        return np.full(len(words), -1), row
    at = np.searchsorted(vocabulary, words).clip(0, len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1), row


def _occurrences(ids: np.ndarray, row: np.ndarray, tokens: np.ndarray, wide: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the given tokens begin, and their places in tokens."""
    if not len(ids) or not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:]))
    code = ids[at] * wide + ids[at + 1]
    if short:
        single = np.flatnonzero(ids >= 0)
        at, code = np.concatenate([at, single]), np.concatenate([code, -2 - ids[single]])
    found = np.searchsorted(tokens, code).clip(0, len(tokens) - 1)
    ok = tokens[found] == code
    return at[ok], found[ok]


def _count(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    w: Windows = shared.value
    total = np.zeros(len(w.tokens), np.int64)
    for _, data, offsets in tk.batches(source):
        ids, row = _numbered(data, offsets, w.vocabulary)
        found = _occurrences(ids, row, w.tokens, len(w.vocabulary), w.short)[1]
        total += np.bincount(found, minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["token", "n"])


def find(ids: np.ndarray, row: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of the windows that occur."""
    at, found = _occurrences(ids, row, w.prefix, len(w.vocabulary), w.short)
    times = w.prefix_at[found + 1] - w.prefix_at[found]
    slot = np.repeat(w.prefix_at[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
    window, begin = w.window[slot], np.repeat(at, times) - w.shift[slot]
    size = w.size[window]
    ok = (begin >= 0) & (begin + size <= len(ids))
    window, begin, size = window[ok], begin[ok], size[ok]
    ok = row[begin] == row[begin + size - 1] if len(begin) else ok[:0]
    window, begin, size = window[ok], begin[ok], size[ok]
    for j in range(w.words.shape[1]):
        ok = (j >= size) | (ids[np.minimum(begin + j, len(ids) - 1)] == w.words[window, j])
        window, begin, size = window[ok], begin[ok], size[ok]
    return begin, window


def _found(data: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[str]]]]:
    """Each text's number of words, and of texts with a hit the hit words (as flags) and the items, sorted."""
    rows = len(offsets) - 1
    ids, row = _numbered(data, offsets, w.vocabulary)
    begin, window = find(ids, row, w)
    first = tk.row_bounds(row, rows)
    of = row[begin]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + w.size[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    times = w.item_at[window + 1] - w.item_at[window]
    slot = np.repeat(w.item_at[window] - np.cumsum(times) + times, times) + np.arange(times.sum())
    held = np.unique(np.stack([np.repeat(of, times), w.items[slot]], 1), axis=0)
    held_at = np.searchsorted(held[:, 0], np.arange(rows + 1))
    return np.diff(first), {int(k): (hit[first[k] : first[k + 1]], [w.names[i] for i in held[held_at[k] : held_at[k + 1], 1]]) for k in np.unique(of)}


def _report(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        n_words, found = _found(data, offsets, shared.value)
        hits, items = np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)]
        for k, (flags, names) in found.items():
            hits[k], items[k] = flags.sum(), names
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array(hits > 0)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _spans(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        found = _found(data, offsets, shared.value)[1]
        keep = pa.array(list(found), pa.int64())
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist() for flags, _ in found.values()]
        columns = [part.column("doc_id").take(keep), part.column("th").take(keep), pa.array(edges, pa.list_(pa.int64())), pa.array([x for _, x in found.values()], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "th", "spans", "items"])


def _clean(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        found = _found(data, offsets, shared.value)[1]
        yield part.filter(pa.array([k not in found for k in range(part.num_rows)], pa.bool_()))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _local(docs: DataFrame, benchmark: DataFrame, span: int, local_bytes: int):  # noqa: ANN202
    """The broadcast windows of a benchmark of at most so many bytes, each token's count over all documents taken into account; None for a larger one."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("name") + 16).alias("n")).first()["n"] or 0) > local_bytes:
        return None
    table, context = Windows([tuple(x) for x in items.collect()], span), docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(partial(_count, shared=context.broadcast(table)), "token long, n long")
    table.choose({r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()})
    return context.broadcast(table)


def _pairs(words: np.ndarray, following: np.ndarray) -> np.ndarray:
    return tk.mix(words * np.uint64(0x9E3779B97F4A7C15) + following * np.uint64(0xC2B2AE3D27D4EB4F))


def _single(words: np.ndarray) -> np.ndarray:
    return tk.mix(words ^ np.uint64(0xA0761D6478BD642F))


def _lists(size: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _windows(source: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Of each window of each item: the item, two hashes, the words and the tokens."""
    for part, data, offsets in tk.batches(source):
        words, row = tk.word_hashes(tk.lower(data), offsets, tk.PLAIN)
        table, size, of = _pad(words, row, part.num_rows, span)
        there = np.arange(span) < size[:, None]
        pairs = np.where(there[:, 1:], _pairs(table[:, :-1], table[:, 1:]), np.uint64(0))
        tokens = np.concatenate([pairs, np.where(size == 1, _single(table[:, 0]), np.uint64(0))[:, None]], 1)
        held = np.concatenate([there[:, 1:], (size == 1)[:, None]], 1)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = table[there]
        hashes = [pa.array(tk.hash_runs(tk.mix(flat ^ np.uint64(salt)), at[:-1], at[1:]).view(np.int64)) for salt in (1, 2)]
        yield pa.RecordBatch.from_arrays([part.column("name").take(pa.array(of)), *hashes, _lists(size, flat), _lists(held.sum(1), tokens[held])], ["name", "w1", "w2", "words", "tokens"])


def _bits(tokens: DataFrame):  # noqa: ANN202
    """A broadcast table of 2^FILTER_BITS bits, set at the tokens' places. At most 2^FILTER_BITS / 64 rows reach the driver."""
    place = F.expr(f"token & {(1 << FILTER_BITS) - 1}")
    slots = tokens.select(F.shiftright(place, 6).alias("slot"), F.expr(f"shiftleft(1L, cast((token & {(1 << FILTER_BITS) - 1}) & 63 as int))").alias("bit"))
    rows = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return tokens.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _held(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = tokens & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _tokens_of(data: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and rows of the texts, and place and value of their tokens that the bits may hold."""
    words, row = tk.word_hashes(tk.lower(data), offsets, tk.PLAIN)
    two = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, np.int64)
    at = np.concatenate([two, np.arange(len(words))])
    tokens = np.concatenate([_pairs(words[two], words[two + 1]), _single(words)])
    ok = _held(tokens, bits)
    return words, row, at[ok], tokens[ok]


def _count_all(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in tk.batches(source):
        tokens, n = np.unique(_tokens_of(data, offsets, shared.value)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])


def _places(source: Iterator[pa.RecordBatch], shared, span: int) -> Iterator[pa.RecordBatch]:
    """Where a prefix token may be: its document, value and place, and the words around it, of which so many lie before it."""
    for part, data, offsets in tk.batches(source):
        words, row, at, tokens = _tokens_of(data, offsets, shared.value)
        bounds = tk.row_bounds(row, part.num_rows)
        for k in range(0, len(at), 1 << 16):
            here, of = at[k : k + (1 << 16)], row[at[k : k + (1 << 16)]]
            low, high = np.maximum(here - span + 2, bounds[of]), np.minimum(here + span, bounds[of + 1])
            size = high - low
            slot = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            doc = pa.array(of)
            columns = [part.column("doc_id").take(doc), part.column("th").take(doc), pa.array(tokens[k : k + (1 << 16)].view(np.int64))]
            columns += [pa.array(here - bounds[of]), pa.array((here - low).astype(np.int32)), _lists(size, words[slot])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "token", "at", "lead", "around"])


def _united(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The united spans (first word, one past the last, alternating) of pairs of begin and size."""
    for part in source:
        out = []
        for found in part.column("found").to_pylist():
            spans: list[int] = []
            for low, high in sorted((x["begin"], x["begin"] + x["size"]) for x in found):
                if spans and low <= spans[-1]:
                    spans[-1] = max(spans[-1], high)
                else:
                    spans += [low, high]
            out.append(spans)
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(out, pa.list_(pa.int64()))], ["id", "th", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _joined(docs: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """hits by joins of tables."""
    shared_folder(docs.sparkSession)
    each = _items(benchmark).mapInArrow(partial(_windows, span=span), "name string, w1 long, w2 long, words array<bigint>, tokens array<bigint>").checkpoint()
    key = ["w1", "w2"]
    windows, names = each.dropDuplicates(key).select(*key, "words", "tokens").checkpoint(), each.select(*key, "name").distinct().checkpoint()
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    counted = docs.select("text").mapInArrow(partial(_count_all, shared=_bits(tokens)), "token long, n long")
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token", "left_semi").checkpoint()
    placed = windows.select(*key, F.posexplode("tokens").alias("shift", "token")).join(counts, "token", "left")
    rarest = placed.groupBy(key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shift", "token")).alias("one")).filter("one.n > 0")
    prefixes = rarest.select(*key, "one.shift", "one.token").join(windows.select(*key, "words"), key).checkpoint()
    schema = "id long, th long, token long, at long, lead int, around array<bigint>"
    places = _keyed(docs).mapInArrow(partial(_places, shared=_bits(prefixes.select("token")), span=span), schema)
    # the window must lie within the document, and all its words must be there
    same = places.join(prefixes, "token").filter("lead >= shift and slice(around, lead - shift + 1, size(words)) = words")
    found = same.select("id", "th", *key, F.struct((F.col("at") - F.col("shift")).alias("begin"), F.size("words").alias("size")).alias("found")).distinct().checkpoint()
    spans = found.select("id", "th", "found").distinct().groupBy("id", "th").agg(F.collect_list("found").alias("found")).mapInArrow(_united, "id long, th long, spans array<bigint>")
    items = found.select("id", "th", *key).distinct().join(names, key).groupBy("id", "th").agg(F.sort_array(F.collect_set("name")).alias("items"))
    other = items.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "items")
    return spans.join(other, spans["id"].eqNullSafe(other["id2"]) & (spans["th"] == other["th2"])).select("id", "th", "spans", "items")


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """id, th (doc_id and the text's xxhash64), the hit spans of words (first, one past the last, alternating) and the items of each document with a hit."""
    shared = _local(docs, benchmark, span, local_bytes)
    if shared is None:
        return _joined(docs, benchmark, span)
    return _keyed(docs).mapInArrow(partial(_spans, shared=shared), "id long, th long, spans array<bigint>, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found with their digest, and whether any word is hit."""
    shared = _local(docs, benchmark, span, local_bytes)
    if shared is not None:
        return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(partial(_report, shared=shared), SCHEMA)
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    found = _joined(docs, benchmark, span).select("id", F.col("th").alias("__th"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    sized = _keyed(docs).mapInArrow(_sizes, "doc_id long, th long, n_words long")
    joined = sized.join(found, sized["doc_id"].eqNullSafe(found["id"]) & (sized["th"] == found["__th"]), "left")
    none = hashlib.sha256(b"").hexdigest()
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_words", number("n_hit"), number("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _sizes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        row = tk.word_bounds(tk.lower(data), offsets, tk.PLAIN)[2]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64))], ["doc_id", "th", "n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """The documents without any hit, with their columns."""
    columns = docs.columns
    names = ["text" if c == "text" else f"c{k}" for k, c in enumerate(columns)]
    work = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    shared = _local(docs, benchmark, span, local_bytes)
    if shared is not None:
        found = work.mapInArrow(partial(_clean, shared=shared), work.schema)
    else:
        bad, own = _joined(docs, benchmark, span).select("id", "th"), work[f"c{columns.index('doc_id')}"].cast("long")
        found = work.join(bad, own.eqNullSafe(bad["id"]) & (F.xxhash64(work["text"]) == bad["th"]), "left_anti")
    return found.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])
