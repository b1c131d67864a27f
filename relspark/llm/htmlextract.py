"""Main text of HTML pages: gradient-boosted trees over DOM nodes, and hierarchical decoding.

A page is read into blocks and runs of text. Each node gets features: its subtree's text and link density, tokens
of its attributes and of those around it, its depth and position, and statistics of its siblings. The trees
give each node the log-odds that its subtree holds main text. Decoding picks, for the whole page, the likeliest
labels in which no kept node lies in a dropped one (a dynamic programme from the leaves up), so an ancestor and
a descendant never contradict each other. The kept runs of text, in page order, are the page's text.

The classifier is trained on PAGES seeded layouts (layouts.py; the bound is this parameter), once for each
driver process, and broadcast. Defined results: a null or empty page has the empty text; repeated rows and null
ids are kept; pages are independent of one another; other columns are not looked at. An unclosed element costs no text after
it, but for those whose content is no markup (dom.RAW), which run to the page's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import dom, layouts
from relspark.llm.boosting import Boosted

PAGES, SEED, BATCH_CHARS = 700, 17, 1 << 20
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int"
_PUNCTUATION = ".,;!?"


def features(pages: list[dom.Page]) -> np.ndarray:
    """One row per node of the pages, in order."""
    sizes = [len(p.tag) for p in pages]
    shift = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)])
    n = sum(sizes)
    tag, mask, under, depth = flat("tag"), flat("mask"), flat("under"), flat("depth")
    parent = flat("parent")
    parent = np.where(parent < 0, np.arange(n), parent + shift)
    end = flat("end") + shift
    chars = np.array([len(x) for p in pages for x in p.text])
    marks = np.array([sum(map(x.count, _PUNCTUATION)) if x else 0 for p in pages for x in p.text])
    linked = flat("linked")
    at = np.arange(n)

    def subtree(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[at]

    text, links, points, nodes, runs = (subtree(x) for x in (chars, linked, marks, np.ones(n, int), (chars > 0).astype(int)))
    first = shift
    last = np.repeat(np.cumsum(sizes), sizes)
    before = np.concatenate([[0], np.cumsum(chars)])
    whole = np.maximum(before[last] - before[first], 1)
    # siblings in page order: nodes sorted by parent keep their order
    order = np.argsort(parent, kind="stable")
    group = np.ones(n, bool)
    group[1:] = parent[order][1:] != parent[order][:-1]
    begin = np.maximum.accumulate(np.where(group, at, 0))
    place, previous, following = np.empty(n, int), np.zeros(n), np.zeros(n)
    place[order] = at - begin
    previous[order[1:]] = np.where(group[1:], 0, text[order[:-1]])
    following[order[:-1]] = np.where(group[1:], 0, text[order[1:]])
    brothers = np.bincount(parent, minlength=n)[parent]
    mean = np.bincount(parent, text, n)[parent] / np.maximum(brothers, 1)
    log = np.log1p
    bits = lambda x: ((x[:, None] >> np.arange(dom.N_MASK)) & 1)
    plain = np.stack(
        [depth, place, brothers, log(text), log(nodes), log(runs), links / np.maximum(text, 1), points / np.maximum(text, 1), text / nodes, (before[at] - before[first]) / whole]
        + [text / whole, text / np.maximum(text[parent], 1), log(previous), log(following), log(mean), text / np.maximum(mean, 1), tag[parent], links[parent] / np.maximum(text[parent], 1)],
        1,
    )
    return np.concatenate([plain, tag[:, None] == np.arange(len(dom.TAGS)), bits(mask), bits(under)], 1).astype(np.float32)


def decode(page: dom.Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest labels of the page's nodes (True: kept) in which a kept node's parent is kept."""
    n = len(page.tag)
    # gain of keeping a node with the best choice for its subtree, over dropping the whole subtree
    gain, parent = odds.tolist(), page.parent
    for k in range(n - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    kept = np.zeros(n, bool)
    for k in range(n):
        kept[k] = gain[k] > 0 and (k == 0 or kept[parent[k]])
    return kept


@lru_cache
def model(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """The classifier; a node's label is whether its subtree holds main text."""
    read = [dom.read(x) for x in layouts.pages(pages, seed)]
    labels = []
    for p in read:
        own = np.array([x.startswith(layouts.MARK) for x in p.text])
        total = np.concatenate([[0], np.cumsum(own)])
        labels.append(total[p.end] > total[: len(own)])
        p.text = [x.replace(layouts.MARK, "") for x in p.text]
    return Boosted().fit(features(read), np.concatenate(labels).astype(float))


def texts(sources: list[str], trees: Boosted) -> list[tuple[str, int]]:
    """The main text and number of blocks of each page."""
    pages = [dom.read(x) for x in sources]
    odds, out, at = trees.decide(features(pages)), [], 0
    for p in pages:
        kept = decode(p, odds[at : at + len(p.tag)])
        at += len(p.tag)
        found = [x for x, k in zip(p.text, kept, strict=True) if k and x]
        out.append(("\n".join(found), len(found)))
    return out


def _extract(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    trees = shared.value

    def made(ids: list, urls: list, pages: list[str]) -> pa.RecordBatch:
        found = texts(pages, trees)
        columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([t for t, _ in found], pa.string())]
        columns += [pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_blocks"])

    ids, urls, pages, size = [], [], [], 0
    for part in source:
        for page_id, url, html in zip(*(part.column(c) for c in ("page_id", "url", "html")), strict=True):
            ids.append(page_id.as_py())
            urls.append(url.as_py())
            pages.append(html.as_py() or "")
            size += len(pages[-1])
            if size > BATCH_CHARS:
                yield made(ids, urls, pages)
                ids, urls, pages, size = [], [], [], 0
    if ids:
        yield made(ids, urls, pages)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of each page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return slim.mapInArrow(partial(_extract, shared=shared), SCHEMA)
