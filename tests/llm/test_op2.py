import hashlib
import io
import random
import tempfile

from pyarrow import fs

from relspark.llm import warc


def brute(rows, least=100):
    first, out, seen = {}, [], set()
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and page is not None:
            first[p] = min(first.get(p, page), page)
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[2] or "").encode(), r[1] or "")):
        p = (html or "").encode()
        again = len(p) >= least and (page != first.get(p, page) or (page, p) in seen)
        seen.add((page, p))
        out.append((page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first.get(p) if again else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    bodies = ["é" * 50, "é" * 49, "x" * 99, "x" * 100, "", None, *("b" * rng.randrange(50, 3000) for _ in range(20))]
    rows = [(k, f"http://h/{k}", rng.choice(bodies)) for k in range(300)]
    rows += [(5, "http://a\r\nX: y", "x" * 100), (5, "http://b", "x" * 100), (None, None, "x" * 100), (None, None, "n" * 200), (None, "u", "n" * 200), (-(1 << 63), "u", "far"), ((1 << 63) - 1, "u", "far" * 90), (None, "z", "far" * 90)]
    return rows


def listing(root):
    store, base = fs.FileSystem.from_uri(root)
    return {f.base_name: store.open_input_stream(f.path, compression=None).read() for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".gz")}


def test_round_trip_and_determinism(spark):
    rows = corpus()
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")
    files = []
    for part in (1, 6):
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
        manifest = warc.write(pages.repartition(part), root, roll=4000, shard_bytes=20_000).collect()
        got = warc.read(spark, root).collect()
        found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
        assert found == brute(rows)
        assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id not in (5, None)}.items() <= {k: (h or "").encode() for k, _, h in rows}.items()
        files.append(listing(root))
        assert {r.path: (r.n_bytes, r.sha256) for r in manifest} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files[-1].items()}
        assert sum(r.n_records for r in manifest) == len(rows)
        shards = sorted({r.shard for r in manifest})
        assert len(shards) > 5 and any(r.part > 0 for r in manifest)
        ids = [r.page_id for r in sorted(got, key=lambda r: r.file) if r.page_id is not None]
        assert ids == sorted(ids)
    assert files[0] == files[1]


def test_hot_ids_are_split(spark):
    """Null ids, one id and one row that hold most of the bytes go to several shards; the same bytes in every run."""
    rng = random.Random(9)
    rows = [(None, f"u{k}", "n" * rng.randrange(90, 120)) for k in range(120)] + [(7, f"u{k}", f"{k}" * 60) for k in range(120)]
    rows += [(9, "v", "same" * 100)] * 150 + [(3, None, "same" * 100), (1, "w", "x"), (None, None, None)] + [(1, "w", "x")] * 60
    files = []
    for part in (2, 5):
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(part)
        manifest = warc.write(pages, root, shard_bytes=20_000).collect()
        got = warc.read(spark, root).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
        shards = {i: {r.file.split("-")[0] for r in got if r.page_id == i} for i in (None, 7, 9, 1)}
        assert min(map(len, shards.values())) > 1, shards
        files.append(listing(root))
        store, base = fs.FileSystem.from_uri(root)
        assert not {x.base_name for x in store.get_file_info(fs.FileSelector(base))} & {"_temporary", "_attempts"}
        assert sum(r.n_records for r in manifest) == len(rows)
    assert files[0] == files[1]
    ids = [x.split(b"\r\n")[0] for f in files[0].values() for m in warc.members(io.BytesIO(f)) for x in m.split(b"WARC-Record-ID: ")[1:]]
    assert len(ids) == len(set(ids)) == len(rows) + len(files[0])


def test_records_are_valid(spark):
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    pages = spark.createDataFrame([(1, "http://a/", "p" * 300), (2, "http://b/", "p" * 300)], "page_id long, url string, html string")
    warc.write(pages, root)
    store, base = fs.FileSystem.from_uri(root)
    (name,) = listing(root)
    with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
        info, first, second = map(warc.parse, warc.members(stream, 7))
    assert info[0]["warc-type"] == "warcinfo" and first[0]["warc-type"] == "response" and second[0]["warc-type"] == "revisit"
    assert second[0]["warc-refers-to"] == first[0]["warc-record-id"] and first[1].endswith(b"\r\n\r\n" + b"p" * 300)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    one = spark.createDataFrame([(1, "u", "é" * 3_000_000)], "page_id long, url string, html string")
    assert [(r.payload_bytes, r.record_type) for r in warc.round_trip(one).collect()] == [(6_000_000, "response")]
