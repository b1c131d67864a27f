import hashlib
import random
import re

import pytest

from relspark.llm import decontaminate

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        for k in range(max(1, len(x) - 9)) if x else ():
            part = x[k : k + 10]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(3)
    pool = ["the", "of", "Über", "naïve", *(f"w{i}" for i in range(12))]
    make = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, make(rng.choice([2, 5, 9, 10, 11, 30]))) for k in range(25)]
    items += [(3, "rare single"), (100, "zebra"), (101, ""), (102, None), (103, items[4][1]), (9, "Über ÜBER x-ray")]
    texts = [None, "", "...", "a zebra", "zebra", "no"]
    for _ in range(80):
        text = make(rng.randrange(5, 60))
        if rng.random() < 0.6:
            text += rng.choice([", ", "\n", " "]) + (rng.choice(items)[1] or "").upper() + " " + make(8)
        texts.append(text)
    return texts, items


@pytest.mark.parametrize("local_bytes", [1 << 20, 0])
def test_against_brute_force(spark, local_bytes):
    """The same rows with the benchmark as one table in the tasks and with joins."""
    texts, items = cases()
    docs = spark.createDataFrame([(k, x, 7, 8, "n") for k, x in enumerate(texts)], "doc_id long, text string, items int, spans int, n_words string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    rows = {r[0]: tuple(r)[1:] for r in decontaminate.report(docs, bench, local_bytes=local_bytes).collect()}
    assert rows == {k: brute(x, items) for k, x in enumerate(texts)}
    kept = decontaminate.clean(docs, bench, local_bytes=local_bytes)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r[-1]}
    found = {r["id"]: (r["spans"], r["items"]) for r in decontaminate.hits(docs, bench, local_bytes=local_bytes).collect()}
    assert {k: (sum(x[1::2]) - sum(x[::2]), len(names)) for k, (x, names) in found.items()} == {k: r[1:3] for k, r in rows.items() if r[1]}


def test_a_large_benchmark_by_joins(spark):
    """More items than go to tasks as a table, many of them alike, and documents that repeat."""
    rng = random.Random(7)
    frame = "which of the following is the best answer to this question".split()
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(frame + make(12))) for k in range(3000)]
    texts = [" ".join(make(80)) for _ in range(60)] + [" ".join(make(20)) + " " + items[k][1] for k in range(0, 3000, 100)]
    texts += [" ".join(make(5) + items[5][1].split()[11:22] + make(5))] * 3
    docs = spark.createDataFrame([(k % 80, x) for k, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.report(docs, bench, local_bytes=100_000).collect()))
    assert got == sorted(map(tuple, decontaminate.report(docs, bench, local_bytes=10**9).collect()))
    assert max(r[3] for r in got) == 3000 and sum(r[5] for r in got) == 33


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    blank = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, decontaminate.report(docs, none).collect()), key=str) == [(1, 2, 0, 0, blank, False)] * 2 + [(None, 0, 0, 0, blank, False)]
    assert decontaminate.report(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(docs, some, local_bytes=0).collect()), key=str)[-1] == (None, 0, 0, 0, blank, False)
    assert decontaminate.report(docs.limit(0), some, local_bytes=0).count() == 0
