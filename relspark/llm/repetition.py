"""Quality rules: suffix-array repetition.

Words are the runs of characters other than white space. For each text a suffix array over its words
is built by prefix doubling (all texts of a chunk together; suffixes of different texts never tie, and
a suffix leaves the sort as soon as it is unique), with one array of ranks. The longest common prefixes of neighbouring
suffixes are found by halving steps on hashes of word runs. They
give the maximal repeated substrings; their spans are united, and a text fails where the united spans
cover too large a share of its words or the longest repeat is too long. Memory is about 100 bytes for each word of a chunk or
of the longest text.

Defined results: a null or empty text has no words and fails (fewer words than the least). Rows are
independent, so repeated rows, ties and clashing columns make no difference, and an empty table gives
an empty result. A null doc_id is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relspark.llm import textkit as tk

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_covered_words long, longest_repeat long, n_maximal_repeats long"
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_SPAN, MAX_COVERED, MAX_LONGEST = 8, 0.3, 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _suffixes(words: np.ndarray, row: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The suffix array of every text, one after the other."""
    n, small = len(words), stop.dtype
    order = np.lexsort((words, row)).astype(small)
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    rank = np.empty(n, small)
    # a suffix's rank is one more than the place of the first of its group; 0 stands for the end of the text
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=small), 0)) + 1
    width = 1
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        place = np.flatnonzero(~alone).astype(small)
        if not len(place):
            return order
        at = order[place]
        ended = at >= stop[at] - width
        follow = rank[np.minimum(at + width, n - 1, dtype=np.int64)]
        follow[ended] = 0
        # head and what follows, as one number
        both = rank[at].astype(np.int64) * (n + 1) + follow
        del follow, ended
        again = np.argsort(both, kind="stable").astype(small)
        at, both = at[again], both[again]
        del again
        order[place] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = both[1:] != both[:-1]
        del both
        new[place] = fresh
        rank[at] = place[np.maximum.accumulate(np.where(fresh, np.arange(len(at), dtype=small), 0))] + 1
        width *= 2


def neighbours(words: np.ndarray, row: np.ndarray, rows: int, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of every text, and the words that each suffix in it shares with the one before (0 at the first)."""
    n = len(words)
    small = np.int32 if n < 1 << 30 else np.int64
    if not n:
        return np.zeros(0, small), np.zeros(0, small)
    stop = tk.row_bounds(row, rows)[1:].astype(small)[row]
    order = _suffixes(words, row, stop)
    power = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, dtype=np.uint64, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.mix(words) * power, dtype=np.uint64, out=total[1:])
    shared = np.zeros(n, small)
    for k in range(1, n, part):
        one, two = order[k - 1 : k + part - 1], order[k : k + part]
        two = two[: len(one)]
        one = one[: len(two)]
        live = np.flatnonzero((words[one] == words[two]) & (row[one] == row[two]))
        if not len(live):
            continue
        left, right = (f(one[live], two[live]).astype(np.int64) for f in (np.minimum, np.maximum))
        most = stop[right] - right  # the later suffix is the shorter one

        def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
            return (total[a + n] - total[a]) * power[b - a] == total[b + n] - total[b]

        def descend(some: np.ndarray, levels: int) -> np.ndarray:
            a, b, limit, got = left[some], right[some], most[some], np.zeros(len(some), np.int64)
            for level in range(levels - 1, -1, -1):
                longer = got + (1 << level)
                ok = longer <= limit
                ok[ok] = alike(a[ok], b[ok], longer[ok])
                got[ok] = longer[ok]
            return got

        # most suffixes share fewer than four words
        four = most >= 4
        four[four] = alike(left[four], right[four], 4)
        few, many = np.flatnonzero(~four), np.flatnonzero(four)
        shared[k + live[few]] = descend(few, 2)
        if len(many):
            shared[k + live[many]] = descend(many, int(most[many].max()).bit_length())
    return order, shared


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words is in one of the spans; no two begin at the same word."""
    reach = np.zeros(n, start.dtype)
    reach[start] = start + length
    return np.maximum.accumulate(reach) > np.arange(n, dtype=start.dtype)


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray, min_span: int = MIN_SPAN) -> dict[str, np.ndarray]:
    """The figures of each text of a chunk."""
    rows = len(offsets) - 1
    start, end, row = tk.word_bounds(data, offsets, tk.WHITE)
    words, n = tk.hash_spans(data, start, end), len(start)
    out = {"n_words": np.bincount(row, minlength=rows)}
    full = np.flatnonzero(np.diff(offsets))

    def of_byte(flag: np.ndarray) -> np.ndarray:
        found = np.zeros(rows, np.int64)
        if len(full):
            found[full] = np.add.reduceat(flag.view(np.uint8), offsets[full], dtype=np.int64)
        return found

    out["word_chars"] = of_byte(((data & 0xC0) != 0x80) & ~tk.WHITE[data])
    out["n_symbols"] = of_byte(_SYMBOL[data])
    s, e, line_row = tk.word_bounds(data, offsets, _NEWLINE)
    wordy = np.searchsorted(start, e) > np.searchsorted(start, s)
    del start, end
    line, line_row = tk.hash_spans(data, s, e)[wordy], line_row[wordy]
    by = np.lexsort((line, line_row))
    same = (line[by][1:] == line[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])
    out["n_dup_lines"] = np.bincount(line_row[by][1:][same], minlength=rows) if len(by) else np.zeros(rows, np.int64)
    del s, e, line, line_row, by, same
    row = row.astype(np.int32)
    order, shared = neighbours(words, row, rows)
    del words
    most = np.zeros(n, shared.dtype)
    if n:
        after = np.append(shared[1:], 0)
        most[order] = np.maximum(shared, after)
    three = np.flatnonzero(most >= 3).astype(most.dtype)
    out["n_repeat_words"] = _per_row(_covered(three, np.full(len(three), 3, most.dtype), n), row, rows)
    long = np.flatnonzero(most >= min_span).astype(most.dtype)
    out["n_covered_words"] = _per_row(_covered(long, most[long], n), row, rows)
    longest = np.zeros(rows, np.int64)
    if n:
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        longest[row[begin]] = np.maximum.reduceat(most, begin)
    out["longest_repeat"] = longest
    # a maximal interval of the suffix array begins where the shared length rises to min_span or more
    rises = (shared >= min_span) & (np.concatenate([shared[:1] * 0, shared[:-1]]) < shared) if n else np.zeros(0, bool)
    out["n_maximal_repeats"] = _per_row(rises, row[order], rows) if n else np.zeros(rows, np.int64)
    return out


def judge(x: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
    fine = (x["n_covered_words"] <= max_covered * x["n_words"]) & (x["longest_repeat"] <= max_longest)
    return failed, ~failed & fine


def _rows(source: Iterator[pa.RecordBatch], max_covered: float, max_longest: int, min_span: int) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        x = measure(data, offsets, min_span)
        failed, kept = judge(x, max_covered, max_longest)
        first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        last = ("n_covered_words", "longest_repeat", "n_maximal_repeats")
        columns = [part.column(0)] + [pa.array(x[k].astype(np.int64)) for k in first] + [pa.array(failed), pa.array(kept)]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array(x[k].astype(np.int64)) for k in last],
            ["doc_id", *first, "base_failed", "kept", *last],
        )


def score(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_span: int = MIN_SPAN) -> DataFrame:
    """The repetition figures and verdict of each document (columns doc_id and text are used)."""
    work = partial(_rows, max_covered=max_covered, max_longest=max_longest, min_span=min_span)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(work, SCHEMA)


def _filtered(source: Iterator[pa.RecordBatch], max_covered: float, max_longest: int, min_span: int) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in tk.batches(source):
        yield part.filter(pa.array(judge(measure(data, offsets, min_span), max_covered, max_longest)[1]))


def keep(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_span: int = MIN_SPAN) -> DataFrame:
    """The documents that the rules keep, with all their columns; no shuffle."""
    work = partial(_filtered, max_covered=max_covered, max_longest=max_longest, min_span=min_span)
    return docs.mapInArrow(work, docs.schema)
