import random

import pytest

from relspark.llm import linededup

LEAST = linededup.MIN_BLOCK_WORDS


def brute(rows, least=LEAST):
    """Cleaned texts, from the definition: a line goes if it lies in consecutive lines of least words or more that stand in an earlier document."""
    docs = sorted({(k, t) for k, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    solid = {d: [x.strip() for x in d[1].split("\n") if x.strip()] for d in docs}
    out, before = {}, set()
    for d in docs:
        lines, gone, own = solid[d], set(), set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j].split())
                if n >= least:
                    own.add(tuple(lines[i : j + 1]))
                    if tuple(lines[i : j + 1]) in before:
                        gone |= set(range(i, j + 1))
        before |= own
        kept, k, whole = [], -1, d[1].split("\n")
        for place, x in enumerate(whole):
            if x.strip():
                k += 1
                if k not in gone:
                    kept.append(x)
            else:
                more = any(y.strip() for y in whole[place:])
                if not (k in gone and k + 1 in gone and more):
                    kept.append(x)
        out[d] = "\n".join(kept)
    return out


def test_patience():
    assert linededup.patience([(0, 1), (1, 2), (3, 4)]) == [0, 1, 2]
    assert linededup.patience([]) == []
    assert len(linededup.patience([(0, 5), (1, 6), (2, 0)])) == 2
    assert linededup.patience([(0, 3), (1, 7), (2, 7), (5, 9)]) == [0, 1, 3]


def check(spark, rows, least=LEAST):
    docs = spark.createDataFrame([(k, t, "z", 7) for k, t in rows], "doc_id long, text string, cut string, n_lines int")
    found = linededup.dedup(docs, least).collect()
    want = brute(rows, least)
    assert sorted(((r.doc_id, r.text, r.cut) for r in found), key=str) == sorted(((k, t if t is None else want[k, t], "z") for k, t in rows), key=str)
    return found


@pytest.mark.parametrize("least", [1, 6, LEAST])
def test_against_brute_force(spark, least):
    rng = random.Random(1)
    line = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 6, 9, 24])))
    common = [line() for _ in range(12)] + ["", "Es."]
    passages = [[line() for _ in range(rng.randrange(1, 7))] for _ in range(6)]
    rows = [(None, "a b c d e f\nx"), (0, None), (1, ""), (2, "\n\n"), (None, "\n".join(passages[0]))]
    for k in range(3, 90):
        body = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            body += [rng.choice(common)] if kind < 0.3 else rng.choice(passages) if kind < 0.5 else [line()]
        rows.append((k, "\n".join(x + rng.choice(["", " ", "\r"]) for x in body)))
        if k % 9 == 0:
            rows += [(k, rows[-1][1]), (k + 1000, rows[-1][1]), (k + 2000, "new one here\n" + rows[-1][1] + "\nand a last one of six words")]
    found = check(spark, rows, least)
    assert sum(r.n_deleted > 0 for r in found) > 20
    sizes = {(k, t): 0 if not t else len(t.split("\n")) for k, t in rows}
    assert sorted(r.n_lines for r in found) == sorted(sizes[x] for x in rows)


def test_blocks_of_different_documents_are_not_one(spark):
    """A line of one document and a line of another are no block together; common lines alone take nothing."""
    a, b = " ".join("abcdefghijkl"), " ".join("mnopqrstuvwx")
    rows = [(0, a + "\none own line"), (1, "another line\n" + b), (2, a + "\n" + b)]
    assert {r.n_deleted for r in check(spark, rows)} == {0}
    often = "Read more about this on our website"
    rows = [(k, f"own words {k} of a text\n{often}\nand the end {k}") for k in range(6)]
    assert {r.n_deleted for r in check(spark, rows)} == {0}


def test_later_holders_meet(spark):
    """Two later documents share a block each of whose lines an earlier document has alone."""
    parts = [" ".join(f"p{i}w{j}" for j in range(8)) for i in range(4)]
    rows = [(k, f"start {k}\n{x}\nend {k}") for k, x in enumerate(parts)] + [(10, "\n".join(parts)), (11, "first\n" + "\n\n".join(parts) + "\nlast")]
    assert {r.doc_id: r.n_deleted for r in check(spark, rows)} == {0: 0, 1: 0, 2: 0, 3: 0, 10: 0, 11: 7}


def test_moved_and_repeated_blocks(spark):
    blocks = [" ".join(f"b{i}w{j}" for j in range(25)) for i in range(6)]
    rows = [(1, "\n".join(blocks)), (2, "\n".join([*reversed(blocks), "x y", blocks[2], blocks[2]]))]
    found = {r.doc_id: r for r in check(spark, rows)}
    assert found[2].text == "x y" and found[2].n_deleted == 8 and found[2].n_moved > 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(docs).count() == 0 and linededup.clean(docs).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_common_passage(spark, n):
    """A passage in every document stays in the first alone; long texts pass."""
    passage = "this passage of many words is in every one of the documents and goes on until it has enough of them"
    rows = [(k, f"own words {k} of its own kind\n{passage}") for k in range(n)] + [(n, "\n".join(f"line {i} is of no other document" for i in range(20000)))]
    out = {r.doc_id: (r.text, r.n_deleted) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == (rows[0][1], 0) and out[n] == (rows[n][1], 0)
    assert all(out[k] == (f"own words {k} of its own kind", 1) for k in range(1, n))


def test_a_list_of_other_documents_lines(spark):
    """A document whose every line is that of another document costs no more than its lines."""
    lines = [" ".join(f"k{k}x{j}" for j in range(LEAST)) for k in range(3000)]
    rows = [(k, x) for k, x in enumerate(lines)] + [(5000, "\n".join(lines)), (5001, "\n".join(lines[::-1]))]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[5000].text == out[5001].text == "" and out[5000].n_deleted == 3000 and sum(r.n_deleted for r in out.values()) == 6000
