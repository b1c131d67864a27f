import random
import re

import numpy as np
import pytest

from relspark.llm import jaccard
from relspark.llm.components import components


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(k)] = min(ids.get(find(k), d), d)
    return sorted(((d, ids.get(find(k)), links[k]) for k, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, "... !"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (None, "one Two,")]
    for k in range(60):
        base = make(rng.randrange(6, 300))
        rows.append((100 * k + 10, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append((100 * k + 11 + j, " ".join(copy).title()))
    return rows


@pytest.mark.parametrize(("block", "local"), [(jaccard.BLOCK, jaccard.LOCAL), (300, 3)])
def test_against_brute_force(spark, block, local):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, b"x") for k, t in rows], "doc_id long, text string, fp binary")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs, block=block, local=local).collect()), key=str)
    assert got == brute(rows)


def test_large_group(spark):
    """A group of near copies is counted exactly, in blocks."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs, block=5000).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("local", [jaccard.LOCAL, 20])
def test_near_copies_in_a_large_family(spark, local):
    """Near copies are found among very many texts that are half alike, and the others stay alone."""
    rng = random.Random(5)
    make = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    shared, rows = make(80), []
    for k in range(600):
        own = make(60)
        rows.append((k, " ".join(shared + own)))
        if k % 10 == 0:
            own[rng.randrange(60)] = "edited"
            rows.append((1000 + k, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs, local=local).collect()}
    assert got == {k: (k % 1000, int(k % 10 == 0)) for k, _ in rows}


def test_recall_in_families_over_several_partitions(spark):
    """Six families of texts a third alike, with a near copy of every fifth text: all are found, and nothing else."""
    rng = random.Random(3)
    make = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for size in (70, 85, 100, 70, 85, 100):
        shared = make(size)
        for k in range(1500):
            base = shared + make(70)
            rows.append((len(rows), " ".join(base)))
            if k % 5 == 0:
                copy = list(base)
                for _ in range(rng.choice([1, 2, 2, 3])):
                    copy[rng.randrange(len(copy))] = make(1)[0]
                rows.append((len(rows), " ".join(copy)))
                a, b = grams(rows[-2][1]), grams(rows[-1][1])
                if len(a & b) >= 0.8 * len(a | b):
                    want |= {rows[-2][0]: 1, rows[-1][0]: 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard.join(docs).collect() if r.n_links} == want and len(want) > 3000


@pytest.mark.parametrize("block", [jaccard.BLOCK, 60])
def test_null_ids_in_a_class(spark, block):
    """A text without an id links like others and names a class only if the class has no other."""
    base = [f"w{k}" for k in range(150)]
    alone = [f"u{k}" for k in range(150)]
    rows = [(None, " ".join([*base[:-1], "x"])), (9, " ".join(base)), (7, " ".join([*base[:-1], "y"])), (None, " ".join(alone)), (None, " ".join([*alone[:-1], "x"]))]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == sorted([(None, 7, 2), (9, 7, 2), (7, 7, 2), (None, None, 1), (None, None, 1)], key=str)


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, label string")
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    classes = {}
    for d, c, _ in brute(rows):
        classes.setdefault(c, []).append(d)
    assert len(got) == len(classes)
    assert sum(d is not None for d, _ in got) == len(got) - 1 and {1, 2, 3} <= {d for d, _ in got}


def test_recall_and_empty(spark):
    bands, rows = jaccard.choose_bands()
    assert jaccard.recall(0.8, rows, bands) >= 0.9999
    values, rng = bands * rows, np.random.default_rng(1)
    least = jaccard.least_alike(values)
    assert (rng.binomial(values, 0.8, 400_000) >= least).mean() > 0.9998 and (rng.binomial(values, 0.5, 400_000) >= least).mean() < 0.001
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 51), (51, 51), (60, 50)], "a int, b int")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 51: 50, 60: 50}
