"""Queries by parts and as text."""

import random

import duckdb
import pytest

from relspark.catalog import Catalog, QueryError, Ref
from relspark.metrics import measured
from relspark.shell import Shell
from relspark.sources import table_of

T1 = [(1, 10, 100), (2, 20, 200), (3, 10, 100), (4, 30, 200)]
T2 = [(100, 999), (200, 888), (300, 777)]
JOINED = [(a, b, c, c, 999 if c == 100 else 888) for a, b, c in T1]


@pytest.fixture
def catalog(spark):
    out = Catalog(spark)
    out.positional("T1", table_of(spark, T1, 3))
    out.positional("t2", table_of(spark, T2, 2))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_queries_by_parts(catalog):
    q, on = catalog.query, ("T1.A3", "=", Ref("T2.A1"))
    assert rows(q("*", ["T1"])) == T1
    assert rows(q([0, 2], ["T1"])) == rows(q(["T1.A1", "T1.2"], ["T1"])) == [(a, c) for a, _, c in T1]
    assert rows(q("*", ["T1"], [("T1.A2", "=", "10")])) == [T1[0], T1[2]]
    assert rows(q("*", ["T1", "T2"], [on])) == JOINED
    assert rows(q(["T1.A1", "T2.A2"], ["T1", "T2"], [on])) == [(r[0], r[4]) for r in JOINED]
    assert rows(q([1, 2, 3], ["T1", "T2"], [on, ("T1.A2", "=", 10)])) == [(10, 100, 100)] * 2
    assert rows(q([("AVG", "T1.A2")], ["T1"])) == [(17.5,)]
    assert rows(q([("SUM", "A2")], ["T1"], [("A3", "=", 100)])) == [(20,)]
    assert rows(q([("SUM", "T1.A2")], ["T1"], group_by=["T1.A3"])) == [(100, 20), (200, 50)]
    assert rows(q([("COUNT", "*"), ("max", 1)], ["T1"])) == [(4, 30)]
    assert rows(q([("SUM", "A2")], ["T1"], [("A1", "<", 0)])) == [(0,)]
    assert rows(q("*", ["T1"], [("A3", "=", 200), ("A2", ">", 20)])) == [(4, 30, 200)]
    assert rows(q(["A3"], ["T1"], group_by=["A3"])) == [(100,), (200,)]


def test_mended_quirks(catalog):
    q = catalog.query
    on = ("T1.A3", "=", Ref("T2.A1"))
    assert rows(q("*", ["T1", "T2"], [on, ("T2.A2", "<", 900)])) == [r for r in JOINED if r[4] < 900]
    assert rows(q(["T1.A1"], ["T1", "T2"], [("T1.A3", "<", Ref("T2.A1"))])) == sorted([(a,) for a, _, c in T1 for x, _ in T2 if c < x])
    assert rows(q(["T1.A1"], ["T1", "T2"], [on, ("T1.A2", ">", Ref("T2.A2"))])) == []
    assert rows(q(["X.A1", "Y.A1"], [("T1", "x"), ("T1", "y")], [("X.A2", "=", Ref("Y.A2"))])) == sorted((a[0], b[0]) for a in T1 for b in T1 if a[1] == b[1])
    assert rows(q("*", ["T1"], [("A1", "=", "abc")])) == [] and len(rows(q("*", ["T1"], [("A1", "!=", "abc")]))) == 4
    assert rows(q(["A1"], ["T1"], [("A2", "<", Ref("A3")), ("A1", ">", Ref(1))])) == []


@pytest.mark.parametrize(
    "parts",
    [("*", ["T1", "T2"]), (["T9.A1"], ["T1"]), (["T1.A7"], ["T1"]), (["nope"], ["T1"]), ("*", ["T1", "T1"], [(0, "=", 1)]), ("*", ["T3"]), ([("MODE", 0)], ["T1"]), ("*", ["T1"], [(0, "like", 1)]), (["A1"], ["T1"], (), ["A2"]), ("*", ["T1"], [(0, "<", "abc")])],
)
def test_errors(catalog, parts):
    with pytest.raises(QueryError):
        catalog.query(*parts)


def test_random_queries_against_duckdb(spark):
    rng, con = random.Random(7), duckdb.connect()
    catalog, sizes = Catalog(spark), {"R": 3, "S": 2, "U": 2}
    for name, n in sizes.items():
        data = [tuple(rng.randrange(6) for _ in range(n)) for _ in range(30)]
        catalog.positional(name, table_of(spark, data, n))
        con.execute(f"create table {name} ({', '.join(f'A{k + 1} int' for k in range(n))})")
        con.executemany(f"insert into {name} values ({', '.join('?' * n)})", data)
    for _ in range(25):
        names = rng.sample(list(sizes), rng.randint(1, 3))
        pick = lambda t: f"{t}.A{rng.randint(1, sizes[t])}"
        where = [(pick(a), rng.choice(["=", "=", "<"]), Ref(pick(b))) for a, b in zip(names, names[1:], strict=False)]
        where += [(pick(rng.choice(names)), rng.choice(["=", "!=", "<", ">", "<=", ">="]), rng.randrange(6)) for _ in range(rng.randint(0, 2))]
        text = " AND ".join(f"{a} {op} {b.name if isinstance(b, Ref) else b}" for a, op, b in where)
        tail = f" FROM {', '.join(names)}" + (f" WHERE {text}" if text else "")
        if rng.random() < 0.5:
            columns = [pick(rng.choice(names)) for _ in range(3)]
            got, want = catalog.query(columns, names, where), f"SELECT {', '.join(columns)}{tail}"
        else:
            key, value = pick(names[0]), pick(names[-1])
            got, want = catalog.query([("SUM", value), ("COUNT", "*")], names, where, [key]), f"SELECT {key}, SUM({value}), COUNT(*){tail} GROUP BY {key}"
        assert rows(got) == sorted(con.execute(want).fetchall()), want


def test_catalog_lists(catalog, spark):
    assert catalog.tables() == ["T1", "T2"] and catalog.arity("t1") == 3 and catalog.size("T2") == 3
    assert rows(catalog.sql("SELECT T1.A1, T2.A2 FROM T1, T2 WHERE T1.A3 = T2.A1")) == [(r[0], r[4]) for r in JOINED]
    value, stats = measured(catalog.query("*", ["T1", "T2"], [("T1.A3", "=", Ref("T2.A1"))]))
    assert len(value) == 4 and (stats.tuples, stats.cells) == (4, 20) and stats.seconds > 0 and "tuples: 4" in str(stats)


def test_shell(spark, tmp_path):
    spark.createDataFrame([(1, 5)], "x int, y int").write.parquet(str(tmp_path / "p"))
    shell = Shell(spark)
    assert "x, y" in shell.run(f"LOAD pts {tmp_path / 'p'}") and "already" in shell.run(f"load PTS {tmp_path / 'p'}")
    assert "PTS (2 columns)" in shell.run("tables") and "LOAD" in shell.run("?")
    assert "5" in shell.run("SELECT y FROM pts WHERE x = 1;") and "Exception" in shell.run("SELECT z FROM pts")
    assert shell.run("") == "" and shell.run("exit") is None
