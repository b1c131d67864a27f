import random
import tempfile

from pyspark.sql import functions as F

import corpus_pipeline
from relspark.llm import linededup, mixing
from tests.llm import test_op3, test_op4, test_op7, test_op10


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def fixture():
    rng = random.Random(12)
    items = [(k, prose(rng, 25)) for k in range(5)]
    shared = prose(rng, 60)
    rows = []
    for k in range(0, 120, 2):
        rows.append([k, "\n".join(prose(rng, rng.randrange(8, 30)) for _ in range(rng.randrange(4, 9)))])
    for k in range(3):
        rows[5 + k][1] += "\n" + shared  # a passage of some documents
        rows[20 + k][1] += " " + items[k][1]  # a benchmark passage
        rows.append([200 + k, rows[30 + k][1]])  # an exact copy
        rows.append([210 + k, " ".join(f"w{i % 4}" for i in range(90))])  # junk
        words = rows[40 + k][1].split()
        rows.append([220 + k, "\n".join(" ".join(words[i : i + 17] + [f"n{i}"] * (i == 0)) for i in range(0, len(words), 17))])  # a near copy, with other lines
    rows.append([230, None])
    return [(k, t, "en", f"s{k % 5}", len(t or "")) for k, t in rows], items


def brute(rows, items):
    kept = [(k, t) for k, t, *_ in rows if test_op7.brute(t)[6]]
    cut = test_op10.brute(kept)
    left = [(k, cut[k, t]) for k, t in kept if cut[k, t].split() or cut[k, t] == t]
    classes = {}
    for d, c, _ in test_op4.brute(left):
        classes[c] = min(classes.get(c, d), d)
    one = [(k, t) for k, t in left if k in set(classes.values())]
    return {k: len(t.split()) for k, t in one if not test_op3.brute(t, items)[-1]}


def test_stages_against_brute_force(spark):
    rows, items = fixture()
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r["size"] for r in out} == brute(rows, items)
    ids = {r.doc_id for r in out}
    assert not ids & {200, 201, 202, 210, 211, 212, 220, 221, 222, 230} and len(ids) > 50


CLASHING = ["cut", "moved", "n_lines", "n_deleted", "end", "start", "quota", "blocks", "shard", "label", "fp", "th", "id", "spans", "items", "n_words", "c0", "kept", "bucket", "offset", "name"]


def test_columns_and_empty(spark):
    """Columns of names that the operators use inside pass through, and every stage takes an empty table, nulls and repeated rows."""
    rows, items = fixture()
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7, None, "en", "s", None), (7, None, "en", "s", None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows[:20] + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0))) for c in CLASHING})
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, given, folder)
            assert found.dtypes == given.dtypes + [x for x in found.dtypes if x[0] in mixing.ADDED], name
            got = found.collect()
            assert (not got) == (given is not docs), name
            assert all(r[c] == f"{c}-{r.doc_id or 0}" for r in got for c in CLASHING), name
            if given is docs:
                nulls = sum(r.text is None for r in got)
                assert nulls == {"quality": 0}.get(name, 3), name
                assert sum(r.doc_id == rows[3][0] for r in got) == (1 if name == "near_dup" else 3), name


def test_emptied_documents_go(spark):
    passage = "\n".join(f"line {i} of words that stand in two documents" for i in range(5))
    docs = spark.createDataFrame([(1, passage, 1), (2, passage, 1), (3, "", 0)], "doc_id long, text string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").collect()) == [1, 3]
    assert linededup.MIN_BLOCK_WORDS == 20
