import html as entities
import re
import time

import numpy as np

from relspark.llm import dom, htmlextract, layouts
from relspark.llm.boosting import Boosted

SF = "/root/testdata/sf0.01/pages.parquet"


def article(source):
    """The blocks of the only article of these plain pages."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    parts = [re.sub(r"[\x20\x09-\x0D]+", " ", entities.unescape(re.sub(r"<br>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inner))]
    return "\n".join(x for x in parts if x)


def test_whole_table(spark):
    pages = spark.read.parquet(SF)
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = htmlextract.extract(pages).collect()
    assert len(rows) == len(want)
    assert [r.page_id for r in rows if r.text != want[r.page_id] or r.n_chars != len(r.text)] == []


def test_held_out_layouts():
    trees, right, total, exact = htmlextract.model(), 0, 0, 0
    sources = layouts.pages(300, 4242)
    for source, (text, _) in zip(sources, htmlextract.texts([s.replace(layouts.MARK, "") for s in sources], trees), strict=True):
        want = [x[1:] for x in dom.read(source).text if x.startswith(layouts.MARK)]
        got = text.split("\n") if text else []
        right += len(set(want) & set(got))
        total += max(len(set(want)), len(set(got)))
        exact += want == got
    print("block agreement", right / total, "whole pages", exact / len(sources))
    assert right / total > 0.95 and exact / len(sources) > 0.8


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(1)
    for _ in range(60):
        page, n = dom.Page(), int(rng.integers(1, 9))
        for k in range(n):
            page.add(0, int(rng.integers(0, k)) if k else -1, 0)
        odds = rng.normal(0, 2, n)
        score = lambda kept: odds[kept].sum()
        every = [np.array([(c >> k) & 1 for k in range(n)], bool) for c in range(1 << n)]
        fit = [x for x in every if all(not x[k] or x[page.parent[k]] for k in range(1, n))]
        kept = htmlextract.decode(page, odds)
        assert any((kept == x).all() for x in fit) and np.isclose(score(kept), max(map(score, fit)))


def test_reader():
    read = lambda s: [x for x in dom.read(s).text if x]
    assert read("a &amp; b &lt;c&gt; &eacute;&#233;<p> x <br>\n y<p>z</b>w</p>") == ["a & b <c> éé", "x y", "zw"]
    assert read("<script>if (a<b) '</p>'</script><!-- <p>no --><style>p{}</style>t<title>u</title>") == ["t"]
    assert read("<ul><li>a<li>b</ul><div title=\"x>y\" class='q'>c<div>d</div>e</div>") == ["a", "b", "c", "d", "e"]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>x < y and <3 <p unclosed") [:3] == ["a", "b", "c"]
    assert read("") == [] and read("<") == ["<"] and read("</p></div><b>") == []
    assert len(read("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_unclosed_elements_and_controls():
    read = lambda s: [x for x in dom.read(s).text if x]
    for name in ("button", "select", "datalist", "noscript", "svg", "math", "canvas", "object", "audio", "video", "template", "nav", "form"):
        found = read(f"<div><p>before</p><{name} class=x> of it <p>after</p><p>more</p></div><p>end</p>")
        assert found == ["before", "of it", "after", "more", "end"], name
    assert read("<p>see <button>Copy</button> for <select><option>a<option>b</select>more</p>") == ["Copy", "a b", "see for more"]
    assert read("<p>E = <math><mi>m</mi></math>c and <object>this</object></p>") == ["E = mc and this"]
    assert read("<template><p>x</template><p>y") == ["y"]
    for name in dom.RAW:
        assert read(f"<p>a</p><{name}>b<p>c</p>") == ["a"], name


def test_extraction_after_unclosed_elements():
    trees = htmlextract.model()
    body = "".join(f"<p>Paragraph {k} of the article has some words, and it ends here.</p>" for k in range(8))
    want = "\n".join(f"Paragraph {k} of the article has some words, and it ends here." for k in range(8))
    for name in ("button", "select", "svg", "math", "canvas", "object", "noscript"):
        (text, _), = htmlextract.texts([f"<html><body><article><{name}>{body}</article></body></html>"], trees)
        assert text == want, name


def test_reader_is_linear():
    for part in ("<a ", "<a \"", "<a '\"", "<", "</", "<!--", "<! ", "<a \"> \"", "<p><a>", "<a></p>", "<template>", "<button>x", "<div><li>", "<script", "</script", "<dd></b>"):
        for source in (part * (300_000 // len(part)), part * (300_000 // len(part)) + ">"):
            began = time.perf_counter()
            dom.read(source)
            assert time.perf_counter() - began < 3, part


def test_boosting_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = Boosted(20, 3).fit(x[:2000], y[:2000])
    assert ((trees.decide(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.98


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>Only one.</p></article>"), (5, "u", "<p>" + "long text here. " * 100_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id, r.text[:9]): r.n_chars for r in htmlextract.extract(pages).collect()}
    assert out[1, ""] == out[2, ""] == 0 and out[5, "long text"] == 1_599_999 and (None, "Only one.") in out
    assert htmlextract.extract(pages.limit(0)).count() == 0
