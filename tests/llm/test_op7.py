import random
import re
import tracemalloc
from collections import Counter

import numpy as np

from relspark.llm import repetition


def brute(text, min_span=repetition.MIN_SPAN):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {i + j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    longest, cover = [0] * n, set()
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
        if longest[i] >= min_span:
            cover |= set(range(i, i + longest[i]))
    failed = n < 50 or 100 * len(hit) > 50 * n
    kept = not failed and len(cover) <= repetition.MAX_COVERED * n and max(longest, default=0) <= repetition.MAX_LONGEST
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, kept, len(cover), max(longest, default=0))


def test_against_brute_force(spark):
    rng, texts = random.Random(5), [None, "", "  \n ", "one", "a a a a a a a", "é ü x\nsame\nsame\n \n \nsame", "x " * 60]
    for k in range(60):
        pool = [f"w{i}é" for i in range(rng.choice([2, 8, 300]))]
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 140))]
        if k % 3 == 0:
            words += words[: rng.randrange(len(words))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", " # "]) for w in words))
    docs = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "doc_id int, text string, kept int")
    rows = {r["doc_id"]: r for r in repetition.score(docs).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r = rows[k]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_covered_words, r.longest_repeat)
        assert got == brute(text), (k, text, got, brute(text))
    kept = repetition.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def test_empty_null_ids_and_long(spark):
    assert repetition.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = " ".join(f"w{i}" for i in range(400_000))
    rows = repetition.score(spark.createDataFrame([(None, words), (None, words)], "doc_id long, text string")).collect()
    assert [(r.n_words, r.kept, r.longest_repeat) for r in rows] == [(400_000, True, 0)] * 2


def test_memory_on_a_long_repetitive_text():
    """About 100 bytes a word: ten million words fit in 1.5 GB (here a million in a tenth of it)."""
    text = np.frombuffer(("a b " * 400_000 + "c d e f g h i j " * 25_000).encode(), np.uint8)
    tracemalloc.start()
    x = repetition.measure(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x["n_words"][0] == 1_000_000 and x["longest_repeat"][0] == 799_998 and peak < 120e6, peak
