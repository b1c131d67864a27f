"""Operators against small fixtures and one another."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from relspark.catalog import Catalog, Ref
from relspark.operators import aggregate, compare_columns, conjunction, join, join_all, project, relational, restrict
from relspark.operators.relational import STRATEGIES
from relspark.plans.explain import physical_nodes, plan_text, summary
from relspark.sources import random_table, table_of


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_restrict(spark):
    t = table_of(spark, [(50, 100), (30, 200), (70, 300)], 2)
    assert bag(restrict(t, 0, 40, ">")) == [(50, 100), (70, 300)]
    assert bag(restrict(t, "A1", 50)) == [(50, 100)] and bag(restrict(t, "a1", "50", "=")) == [(50, 100)]
    assert bag(restrict(t, "A2", 200, "<=")) == [(30, 200), (50, 100)]
    assert bag(restrict(t, 0, "abc", "==")) == [] and len(bag(restrict(t, 0, "abc", "!="))) == 3
    assert bag(conjunction(t, [(0, ">=", 50), (1, "<>", 300)])) == [(50, 100)]
    assert bag(compare_columns(t, 0, "<", 1)) == bag(t)
    for bad, error in (((0, 1, "~"), ValueError), ((2, 1, "="), LookupError), (("A9", 1, "="), LookupError), ((0, "abc", "<"), TypeError), ((-1, 1, "="), LookupError)):
        with pytest.raises(error):
            restrict(t, *bad)


def test_project(spark):
    t = table_of(spark, [(1, 10, 5.5), (1, 10, 5.5)], 3)
    assert bag(project(t, [2, 0, 0])) == [(5.5, 1, 1)] * 2
    assert bag(project(table_of(spark, [], 3), [1])) == []


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_join_strategies_agree(spark, strategy):
    rng = random.Random(3)
    left = [(k, rng.randrange(8)) for k in range(40)]
    right = [(rng.randrange(8), 100 * k) for k in range(30)]
    want = sorted((a, b, c, d) for (a, b), (c, d) in itertools.product(left, right) if b == c)
    found = join(table_of(spark, left, 2), table_of(spark, right, 2), (1, 0), strategy)
    assert sorted(map(tuple, found.collect())) == want and found.columns == ["A1", "A2", "A1_2", "A2_2"]
    empty = table_of(spark, [], 2)
    assert bag(join(empty, table_of(spark, right, 2), (1, 0), strategy)) == [] == bag(join(table_of(spark, left, 2), empty, (1, 0), strategy))


def test_hints_reach_the_plan(spark):
    left, right = random_table(spark, 2, 10, 1000), random_table(spark, 2, 10, 1000, 5)
    for strategy, node in (("hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin"), ("sort_merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct")):
        assert node in physical_nodes(join(left, right, (0, 0), strategy)), strategy
    relational.BROADCAST_BYTES, kept = 100, relational.BROADCAST_BYTES
    try:
        assert "ResolvedHint" not in plan_text(join(left, right, (0, 0), "broadcast")) and relational.estimated_bytes(right) > 100
    finally:
        relational.BROADCAST_BYTES = kept
    assert "SortMergeJoin" in summary(join(left, right, (0, 0), "sort_merge"))


def test_join_conditions(spark):
    a, b = table_of(spark, [(1, 5), (2, 6)], 2), table_of(spark, [(1, 4), (1, 9), (2, 6)], 2)
    assert bag(join(a, b, [(0, "=", 0), (1, "<", 1)])) == [(1, 5, 1, 9)]
    assert bag(join(a, b, [(0, "<", 0)])) == [(1, 5, 2, 6)]
    with pytest.raises(ValueError):
        join(a, b, [])
    with pytest.raises(ValueError):
        join(a, b, (0, 0), "zigzag")
    with pytest.raises(ValueError):
        join_all([a, b], [])


def test_dealt_join(spark, monkeypatch):
    """Joins with "<" and the like beyond PAIRS: all pairs of rows once, whatever the keys, in tasks of a few pairs of blocks."""
    for name, value in (("PAIRS", 500), ("BLOCK", 10), ("DEALT", 200)):
        monkeypatch.setattr(relational, name, value, raising=False)
    rng = random.Random(5)
    one = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(20)) for _ in range(150)]  # with copies
    other = [(rng.choice([1, 1, 1, 2, 4, None]), rng.choice([None, *range(20)])) for _ in range(200)]
    a, b = spark.createDataFrame(one, "k int, v int"), spark.createDataFrame(other, "k long, v int")
    same = [(*x, *y) for x in one for y in other if None not in (*x, *y) and x[0] == y[0]]
    want = sorted(p for p in same if p[1] < p[3])
    found = join(a, b, [("k", "=", "k"), ("v", "<", "v")])
    assert sorted(map(tuple, found.collect())) == want and found.columns == ["k", "v", "k_2", "v_2"] and found.dtypes[0][1] == "int"
    for strategy in STRATEGIES:
        assert sorted(map(tuple, join(a, b, [("v", "<", "v"), ("k", "=", "k")], strategy).collect())) == want, strategy
    assert sorted(map(tuple, join(a, b, [("k", "==", "k"), ("v", "!=", "v")]).collect())) == sorted(p for p in same if p[1] != p[3])
    assert bag(join(a, b, [("v", ">=", "v")])) == sorted(((*x, *y) for x in one for y in other if y[1] is not None and x[1] >= y[1]), key=str)
    assert sorted(map(tuple, join(a, a, [("k", "=", "k"), ("v", "<", "v")]).collect())) == sorted((*x, *y) for x in one for y in one if None not in (*x, *y) and x[0] == y[0] and x[1] < y[1])
    assert "explode" in plan_text(found) and "explode" not in plan_text(join(a, b, ("k", "k")))
    nan = float("nan")
    c = spark.createDataFrame([((0.0, -0.0, nan)[k % 3], k) for k in range(90)], "k double, v int")
    signs = join(c, c, [("k", "=", "k"), ("v", "<", "v")])
    assert signs.count() == 60 * 59 // 2 + 30 * 29 // 2 and "explode" in plan_text(signs)
    monkeypatch.setattr(relational, "FEW", 0)
    assert sorted(map(tuple, join(a, b, [("k", "=", "k"), ("v", "<", "v")]).collect())) == want
    assert join(a.limit(0), b, [("k", "=", "k"), ("v", "<", "v")]).count() == 0 == join(a.limit(0), b, [("v", "<", "v")]).count()


def test_dealt_join_spreads_a_key(spark, monkeypatch):
    for name, value in (("PAIRS", 10_000), ("BLOCK", 20)):
        monkeypatch.setattr(relational, name, value, raising=False)
    a, b = spark.range(600).selectExpr("0 as k", "id as v"), spark.range(800).selectExpr("0 as k", "id as v")
    catalog = Catalog(spark)
    catalog.register("one", a), catalog.register("other", b)
    for found in (join(a, b, [("k", "=", "k"), ("v", "<", "v")]), catalog.query("*", ["one", "other"], [("other.v", ">", Ref("one.v")), ("one.k", "=", Ref("other.k"))])):
        tasks = [n for _, n in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 600 * 599 // 2 + 600 * 200 and max(tasks) < sum(tasks) / 10


def test_aggregate(spark):
    t = table_of(spark, [(1, 101, 5, 10.0), (2, 101, 3, 10.0), (3, 102, 7, 15.0), (4, 102, 2, 15.0), (5, 103, 4, 20.0)], ["id", "product", "qty", "price"])
    one = lambda *a: aggregate(t, *a).collect()[0][0]
    assert [one("qty", "sum"), one("price", "AVG"), one("qty", "Min"), one("price", "MAX"), one("*", "COUNT")] == [21, 14.0, 2, 20.0, 5]
    assert bag(aggregate(t, "qty", "SUM", ["product"])) == [(101, 8), (102, 9), (103, 4)]
    assert bag(aggregate(t, 3, "AVG", [1])) == [(101, 10.0), (102, 15.0), (103, 20.0)]
    empty = table_of(spark, [], 1)
    assert [aggregate(empty, 0, f).collect()[0][0] for f in ("SUM", "AVG", "MIN", "MAX", "COUNT")] == [0] * 5
    assert bag(aggregate(empty, 0, "SUM", [0])) == []
    with pytest.raises(ValueError):
        aggregate(t, 0, "MEDIAN")


def test_pushdown(spark):
    sf = "/root/testdata/sf0.001"
    orders, customer = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    found = project(conjunction(join(orders, customer, ("o_custkey", "c_custkey")), [("c_acctbal", ">", 5000), ("o_totalprice", ">", 1000)]), ["o_orderkey", "c_name"])
    text = plan_text(found)
    assert "GreaterThan(c_acctbal,5000.0)" in text and "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text
