import zlib

import numpy as np
from pyspark.sql import functions as F

from relspark.llm import language

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.mixture.startswith(f"{r.lang_pred}:") and len(r.mixture.split(",")) == r.n_languages for r in rows if r.lang_pred != "und")
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right)
    assert right > 0.97


def test_mixture_proportions(spark):
    docs = spark.read.parquet(SF).filter("length(text) > 800")
    model = language.train(docs)
    text = {r.lang: r.text.split()[:300] for r in docs.collect()}
    mixed = " ".join(text["en"][:90] + text["de"][:30]).encode()
    data = np.frombuffer(mixed, np.uint8)
    best, score, count, mixture = language.infer(data, np.array([0, len(data)]), model)
    assert model.names[best[0]] == "en" and 0.65 < score[0] < 0.85 and count[0] == 2
    assert mixture[0].argmax() == best[0] and abs(mixture[0].sum() - 1) < 1e-5 and (mixture[0] > 0).sum() == 2


def test_four_languages(spark):
    """The set is as large as the likelihood asks for."""
    docs = spark.read.parquet(SF).filter("length(text) > 800")
    model = language.train(docs)
    text = {r.lang: r.text.split()[:90] for r in docs.collect()}
    data = np.frombuffer(" ".join(w for name in model.names for w in text[name]).encode(), np.uint8)
    best, score, count, mixture = language.infer(data, np.array([0, len(data)]), model)
    assert len(model.names) == 4 and count[0] == 4 and 0.2 < score[0] < 0.32


def test_likelihood_never_falls():
    rng = np.random.default_rng(0)
    likely = rng.random((200, 3)).astype(np.float32) + 1e-3
    row = np.sort(rng.integers(0, 4, 200))
    start, words = np.searchsorted(row, np.arange(4)), np.bincount(row)
    share, last = np.full((4, 3), 1 / 3, np.float32), -np.inf
    for _ in range(8):
        share, fit = language._em(likely, row, start, words, share, 1)
        assert (fit >= last - 1e-4).all() and np.allclose(share.sum(1), 1, atol=1e-5)
        last = fit


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? …", None), (4, "the and of", "en"), (4, "the and of", "en"), (None, "der die und", "de"), (6, "ж", None), (7, "x" * 300_000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    out = [(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()]
    assert len(out) == len(rows)
    assert all(p == "und" for d, p in out if d in (1, 2, 3)) and all(p != "und" for d, p in out if d in (4, None, 6, 7))
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
