"""Language identification by multilingual mixture inference.

The model holds, for each language, the frequencies of byte trigrams within words (ASCII letters in lower
case; digits and other ASCII separate words), counted over all training documents and smoothed. A word's
likelihood under a language is the product over its trigrams. For each document expectation-maximisation
estimates the proportions of the languages from its words' likelihoods, until they settle. Then the document's language set is
selected: with the likeliest k languages for k = 1, 2, ... (up to all, until no larger k can reach a higher value),
proportions are estimated anew, and the k with the
highest log-likelihood less PENALTY * k * log(words + 1) holds. The prediction is the language with the largest
proportion in that set, the score its proportion; mixture lists the set with its proportions.

The model's size is bounded by the number of languages times 2^BITS, whatever the corpus. Defined results: a
null text or a text without a letter is `und` with score 0; ties go to the language first in order; a text
whose only letters form no word cannot occur (a letter is part of a word); without training documents all
is `und` with an empty mixture. Repeated rows each get their row; a null doc_id is not held out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk

BITS, SMOOTH, ROUNDS, SETTLED, PENALTY = 15, 0.5, 12, 1e-3, 2.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_languages int, mixture string"
_SEP = tk.PLAIN.copy()
_SEP[0x30:0x3A] = True
_ASCII_LETTER = ~_SEP[:128]


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of the bytes in words, where each word's codes begin, its row, and each code's row."""
    low = tk.lower(data)
    start, end, row = tk.word_bounds(low, offsets, _SEP)
    inside = ~_SEP[low]
    values = np.where(inside, low, 0x20).astype(np.uint32)
    before, after = np.empty_like(values), np.empty_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    if len(values):
        before[0] = after[-1] = 0x20
        before[start], after[end - 1] = 0x20, 0x20  # a row's end ends a word too
    code = ((before << np.uint32(16) | values << np.uint32(8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    return code[inside], at, row, np.repeat(row, size)


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part, data, offsets in tk.batches(source):
        codes, _, _, of = _trigrams(data, offsets)
        names, which = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        both = np.bincount(which[of] * (1 << BITS) + codes, minlength=len(names) << BITS).reshape(len(names), 1 << BITS)
        for name, counts in zip(names, both, strict=True):
            total[name] = total.get(name, 0) + counts
    for name, counts in total.items():
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(there)), pa.array(there.astype(np.int32)), pa.array(counts[there].astype(np.int64))], ["lang", "code", "n"])


class Model:
    def __init__(self, rows: list[tuple[str, int, int]], names: list[str]) -> None:
        self.names = sorted(names)
        counts = np.full((len(self.names), 1 << BITS), SMOOTH)
        place = {name: k for k, name in enumerate(self.names)}
        for lang, code, n in rows:
            counts[place[lang], code] += n
        self.log = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame) -> Model:
    """The model of all documents given (columns text and lang; those without lang are left out)."""
    labelled = docs.filter("lang is not null and text is not null").select("text", "lang")
    counted = labelled.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in counted.collect()]  # at most languages * 2^BITS
    return Model(rows, list({r[0] for r in rows}))


def _em(likely: np.ndarray, row: np.ndarray, start: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many rounds, and the log-likelihood under them. likely: words x languages; share: texts x languages.

    A text whose proportions move by less than SETTLED in a round is done; the others go on without it.
    """
    share, live, part, of, begin, n = share.copy(), np.arange(len(words)), likely, row, start, words
    for _ in range(rounds):
        odds = part * share[live][of]
        odds /= odds.sum(1, keepdims=True)
        new = np.add.reduceat(odds, begin, axis=0) / n[:, None]
        moving = np.abs(new - share[live]).max(1) >= SETTLED
        share[live] = new
        if not moving.any():
            break
        if n[moving].sum() < 0.7 * n.sum():
            part, live, n = part[moving[of]], live[moving], n[moving]
            of, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    return share, np.add.reduceat(np.log((likely * share[row]).sum(1), dtype=np.float64), start)


def infer(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the place of its language in model.names (-1: none), its proportion, the number of languages, and all languages' proportions."""
    rows, n = len(offsets) - 1, len(model.names)
    best, score, count, mixture = np.full(rows, -1), np.zeros(rows), np.zeros(rows, np.int32), np.zeros((rows, n), np.float32)
    codes, at, row, _ = _trigrams(data, offsets)
    if not len(row) or not n:
        return best, score, count, mixture
    log = np.stack([np.add.reduceat(model.log[k][codes], at[:-1]) for k in range(n)], 1)
    top = log.max(1, keepdims=True)
    likely = np.exp(log - top) + np.float32(1e-30)  # a factor common to a word's languages changes nothing
    full = np.flatnonzero(np.bincount(row, minlength=rows))
    start, local = np.searchsorted(row, full), np.searchsorted(full, row)
    words = np.diff(np.append(start, len(row)))
    share, fit = _em(likely, local, start, words, np.full((len(full), n), 1 / n, np.float32), ROUNDS)
    # no proportions reach more than this: the likelihood's slope at these ones, by Jensen's inequality; with room for rounding
    slope = np.add.reduceat(likely / (likely * share[local]).sum(1, keepdims=True), start, axis=0, dtype=np.float64) / words[:, None]
    ceiling = fit + words * (np.log(slope.max(1)) + 1e-5) + 1e-6
    order = np.argsort(-share, axis=1, kind="stable")
    value = np.full(len(full), -np.inf)
    for k in range(1, n + 1):
        still = np.flatnonzero(ceiling - PENALTY * k * np.log(words + 1) > value)
        if not len(still):
            break
        flag = np.zeros(len(full), bool)
        flag[still] = True
        part, size = likely[flag[local]], words[still]
        mask = np.zeros((len(still), n), np.float32)
        np.put_along_axis(mask, order[still, :k], 1, 1)
        some = mask * share[still] + mask * np.float32(1e-6)
        some, fit = _em(part, np.repeat(np.arange(len(still)), size), np.cumsum(size) - size, size, some / some.sum(1, keepdims=True), ROUNDS // 2 if k > 1 else 0)
        fit -= PENALTY * k * np.log(size + 1)
        better = fit > value[still]
        lead, at = some.argmax(1)[better], still[better]
        value[at] = fit[better]
        best[full[at]], score[full[at]] = lead, some[better, lead]
        count[full[at]], mixture[full[at]] = k, some[better]
    return best, np.clip(score, 0, 1), count, mixture


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (of any script)."""
    edges = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets]) > 0
    out = edges((data < 0x80) & _ASCII_LETTER[data & 0x7F])
    for k in np.flatnonzero(~out & edges(data >= 0x80)):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
    return out


def _predict(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = np.array([*model.names, "und"], dtype=object)
    for part, data, offsets in tk.batches(source):
        best, score, count, mixture = infer(data, offsets, model)
        none = ~lettered(data, offsets)
        best[none], score[none], count[none] = -1, 0, 0
        listed = [",".join(f"{names[j]}:{x[j]:.3f}" for j in np.argsort(-x, kind="stable")[:k]) for x, k in zip(mixture, count, strict=True)]
        columns = [part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(count), pa.array(listed, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "n_languages", "mixture"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (passed on), lang_pred, score, n_languages and mixture (language:proportion, largest first) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(partial(_predict, shared=shared), SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the documents whose crc32(doc_id as text) mod 3 is not 1, and predicts all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(marked, train(marked.filter(~F.col("held_out"))))
