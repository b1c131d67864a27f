"""The dat source, tables by place, layouts and streams."""

import random
import struct

import pytest

from relspark.operators import aggregate, get_with_index, index_scan, join, project, restrict
from relspark.plans.explain import physical_nodes, plan_text
from relspark.plans.layouts import AdaptiveHashLayout, BlockIndex, HashLayout, RangeLayout, index_join
from relspark.shared import delete_folder, shared_folder
from relspark.sources import get_block, get_dat_block, get_dat_tuple, get_tuple, random_table, register, rows_between, seeded_table, table_of
from relspark.streaming import stream_to


def put(path, rows):
    path.write_bytes(struct.pack("<II", len(rows), len(rows[0])) + b"".join(struct.pack(f"<{len(r)}i", *r) for r in rows))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dat(spark, tmp_path):
    register(spark)
    data = [(k, k * k % 97, -k) for k in range(1003)]
    df = spark.read.format("dat").option("splitBytes", 4000).load(put(tmp_path / "a.dat", data))
    assert df.columns == ["A1", "A2", "A3"] and rows(df) == sorted(data) and df.rdd.getNumPartitions() > 2
    df.coalesce(1).write.format("dat").mode("append").save(str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.dat")
    assert part.read_bytes() == (tmp_path / "a.dat").read_bytes()
    df.repartition(3).write.format("dat").mode("append").save(str(tmp_path / "out"))
    assert rows(spark.read.format("dat").load(str(tmp_path / "out"))) == sorted(data * 2)
    df.write.format("dat").mode("overwrite").save(str(tmp_path / "out"))
    assert rows(spark.read.format("dat").load(str(tmp_path / "out"))) == sorted(data)
    assert not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".dat"]
    assert rows(restrict(df, 0, 5, "<")) == sorted(data)[:5]


def test_dat_errors(spark, tmp_path):
    register(spark)
    (tmp_path / "short.dat").write_bytes(b"abc")
    (tmp_path / "cut.dat").write_bytes(struct.pack("<II", 5, 5))
    for name, text in (("none.dat", "none.dat"), ("short.dat", "header"), ("cut.dat", "fit")):
        with pytest.raises(Exception, match=text):
            spark.read.format("dat").load(str(tmp_path / name)).count()
    with pytest.raises(Exception, match="32-bit"):
        spark.range(3).write.format("dat").mode("append").save(str(tmp_path / "o"))
    with pytest.raises(Exception, match="null"):
        spark.sql("select cast(null as int) a").write.format("dat").mode("append").save(str(tmp_path / "o"))


def test_tables_by_place(spark, tmp_path):
    table_of(spark, [(k, 10 * k) for k in range(11)], 2).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert rows(get_tuple(t, 3)) == [(3, 30)] and rows(get_tuple(t, 99)) == []
    assert rows(get_block(t, 2, 4)) == [(8, 80), (9, 90), (10, 100)]
    many = table_of(spark, [(k, 10 * k) for k in range(23)], 2).repartitionByRange(4, "A1").sortWithinPartitions("A1")
    many.write.parquet(str(tmp_path / "many"))
    several = spark.read.parquet(str(tmp_path / "many"))
    assert len(several.inputFiles()) > 2
    for start, stop in ((0, 5), (4, 19), (20, 99), (50, 60), (7, 7)):
        assert rows(rows_between(several, start, stop)) == [(k, 10 * k) for k in range(start, min(stop, 23))]
    assert rows(get_tuple(several, 17)) == [(17, 170)] and rows(get_block(several, 5, 4)) == [(20, 200), (21, 210), (22, 220)]
    register(spark)
    many.write.format("dat").mode("append").save(str(tmp_path / "d"))
    dat = str(tmp_path / "d")
    assert rows(get_dat_tuple(spark, dat, 17)) == [(17, 170)] and rows(get_dat_tuple(spark, dat, 99)) == []
    assert rows(get_dat_block(spark, dat, 1, 10)) == [(k, 10 * k) for k in range(10, 20)] and rows(get_dat_block(spark, dat, 0)) == [(k, 10 * k) for k in range(4)]
    assert rows(seeded_table(spark, 50, (9, 4))) == rows(seeded_table(spark, 50, (9, 4)).repartition(3)) and seeded_table(spark, 500, (9,)).distinct().count() == 500
    r = random_table(spark, 3, 7, 500, seed=1)
    assert r.count() == 500 and rows(r) == rows(random_table(spark, 3, 7, 500, seed=1)) and {v for x in r.collect() for v in x} == set(range(7))


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("layouts")
    data = [(k, (k + 1) * 100) for k in range(5)] + [(7, 1), (7, 2)]
    df = table_of(spark, data, 2)
    df.repartition(2).write.parquet(str(top / "data"))
    made = [HashLayout(4), AdaptiveHashLayout(2), RangeLayout(str(top / "range"), 2), BlockIndex(str(top / "data"), str(top / "blocks"), 2)]
    return data, [x.build(df, "A1") for x in made]


def test_points_and_ranges(layouts):
    data, made = layouts
    for layout in made:
        assert rows(index_scan(layout, 2)) == [(2, 300)] and rows(get_with_index(layout, "7")) == [(7, 1), (7, 2)] and rows(index_scan(layout, 99)) == []
        assert layout.stats().count() >= 1
        with pytest.raises(ValueError):
            index_scan(layout, 2, "!=")
        if isinstance(layout, HashLayout):
            for extra in ({"op": ">"}, {"high": 3}):
                with pytest.raises(TypeError):
                    index_scan(layout, 2, **extra)
            continue
        assert rows(index_scan(layout, 1, high=3)) == [r for r in data if 1 <= r[0] <= 3]
        for op, keep in ((">", lambda x: x > 3), (">=", lambda x: x >= 3), ("<", lambda x: x < 3), ("<=", lambda x: x <= 3)):
            assert rows(index_scan(layout, 3, op)) == [r for r in data if keep(r[0])], op
        assert rows(project(index_scan(layout, 2), ["A2"])) == [(300,)]


def test_reopening_and_entries(spark, tmp_path):
    data = [(k % 9, k) for k in range(100)]
    df = table_of(spark, data, 2)
    for kind in (HashLayout(4, path=str(tmp_path / "h")), AdaptiveHashLayout(10, path=str(tmp_path / "a"))):
        kind.build(df, "A1")
        again = type(kind).open(spark.newSession(), kind.path)
        assert again.buckets == kind.buckets and again.column == "A1" and rows(index_scan(again, 4)) == [x for x in sorted(data) if x[0] == 4]
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    made = BlockIndex(str(tmp_path / "t"), str(tmp_path / "b"), 10).build(df, "A1")
    index = BlockIndex.open(spark, str(tmp_path / "t"), str(tmp_path / "b"), "A1", 10)
    assert rows(index_scan(index, 3, high=4)) == rows(index_scan(made, 3, high=4)) == [x for x in sorted(data) if 3 <= x[0] <= 4]
    want = sorted({(k % 9, k // 10) for k in range(100)})
    assert [tuple(r) for r in index.scan_range(5, 9).select("key", "block").collect()] == want[5:9] and index.get_entry(2).first().block == want[2][1]


def test_block_index_reads_the_files_found(spark, tmp_path):
    table_of(spark, [(k, k) for k in range(4000)], 2).repartitionByRange(8, "A1").write.parquet(str(tmp_path / "t"))
    index = BlockIndex(str(tmp_path / "t"), str(tmp_path / "b"), 64).build(spark.read.parquet(str(tmp_path / "t")), "A1")
    some = index_scan(index, 100, high=120)
    assert len(some.inputFiles()) == 1 and some.count() == 21 and "PushedFilters: [IsNotNull(A1), GreaterThanOrEqual(A1,100)" in plan_text(some)
    assert index_scan(index, 9999).count() == 0


def test_shared_folder(spark):
    assert shared_folder(spark) == "file://" + spark.sparkContext.getCheckpointDir().removeprefix("file:") and "/shared/" in shared_folder(spark)
    spark.range(3).write.parquet(path := f"{shared_folder(spark)}/some")
    delete_folder(spark, path)
    delete_folder(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_unbuilt():
    for layout in (HashLayout(), AdaptiveHashLayout(), RangeLayout("/x"), BlockIndex("/x", "/y")):
        with pytest.raises(RuntimeError):
            index_scan(layout, 1)


def test_index_join_has_no_exchange(spark):
    left, right = random_table(spark, 2, 50, 300), random_table(spark, 2, 50, 200, 9)
    a, b = HashLayout(4).build(left, 0), HashLayout(4).build(right, 1)
    want = rows(join(left, right, (0, 1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = index_join(a.table(), b, 0)
        assert not [n for n in physical_nodes(found) if n == "Exchange"]
        assert rows(found) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_layout_skips(spark, tmp_path):
    layout = RangeLayout(str(tmp_path / "r"), 8).build(random_table(spark, 2, 10_000, 50_000), 0)
    some = index_scan(layout, 100, high=120)
    files = some.selectExpr("_metadata.file_name f").distinct().count()
    assert files == 1 and some.count() == restrict(restrict(layout.table(), 0, 100, ">="), 0, 120, "<=").count()
    again = RangeLayout.open(spark, str(tmp_path / "r"), "A1")
    assert rows(index_scan(again, 100)) == rows(index_scan(layout, 100))


def test_adaptive_layout_grows(spark):
    assert AdaptiveHashLayout(100).build(random_table(spark, 1, 9, 1000), 0).buckets == 16


def test_seeded_benchmark_tables(spark):
    rng, made = random.Random(42), {}
    for name, n, tops in (("commandes", 10000, (10000, 1000)), ("produits", 1000, (5000,)), ("ventes", 5000, (10000, 500)), ("clients", 3000, (1000,)), ("stocks", 10000, (1000, 500))):
        made[name] = table_of(spark, [(k, *(rng.randrange(t) for t in tops)) for k in range(n)], 1 + len(tops))
    b1 = join(restrict(made["commandes"], "A2", 9900, ">"), made["produits"], ("A3", "A1"))
    assert tuple(b1.selectExpr("count(*)", "sum(A2)", "sum(A2_2)").first()) == (108, 1074439, 276498)
    b2 = join(made["ventes"], made["clients"], ("A3", "A1"), "sort_merge")
    assert tuple(b2.selectExpr("count(*)", "sum(A2)", "sum(A2_2)").first()) == (5000, 24635517, 2595161)
    b3 = index_scan(AdaptiveHashLayout(1000).build(made["stocks"], "A2"), 42)
    assert tuple(b3.selectExpr("count(*)", "sum(A1)", "sum(A3)").first()) == (12, 63351, 2520)


def test_operators_over_a_stream(spark, tmp_path):
    table_of(spark, [(1, 10, 100), (2, 20, 200), (3, 10, 100)], 3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("A1 int, A2 int, A3 int").parquet(str(tmp_path / "in"))
    dept = table_of(spark, [(100, 999), (200, 888)], 2)
    q = stream_to(project(join(restrict(stream, 1, 10), dept, ("A3", "A1")), ["A1", "A2_2"]), "joined", str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert rows(spark.table("joined")) == [(1, 999), (3, 999)]
    q = stream_to(aggregate(stream, "A1", "SUM", ["A3"]), "summed", str(tmp_path / "c2"), "complete")
    q.awaitTermination(60)
    assert rows(spark.table("summed")) == [(100, 4), (200, 2)]
