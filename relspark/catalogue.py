"""The query catalogue: one entry for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import Catalog, QueryError, Ref
from relspark.metrics import measured
from relspark.operators import aggregate, compare_columns, conjunction, get_with_index, index_scan, join, join_all, project, restrict
from relspark.plans.explain import summary
from relspark.plans.layouts import AdaptiveHashLayout, BlockIndex, HashLayout, RangeLayout, index_join
from relspark.shared import shared_folder
from relspark.shell import Shell
from relspark.sources import get_block, get_dat_block, get_dat_tuple, get_tuple, random_table, register, rows_between, seeded_table
from relspark.streaming import stream_to

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/relspark-{uuid.uuid4().hex}"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Enters a query under its function's name, with its SQL."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return enter


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_filter_both"](spark, sf_dir)


@query("SELECT * FROM nation")
def scan_full(spark, sf):
    return table(spark, sf, "nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER () - 1 AS k FROM nation) WHERE k = 7")
def get_tuple_by_place(spark, sf):
    return get_tuple(table(spark, sf, "nation"), 7)


@query("SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER () - 1 AS k FROM nation) WHERE k >= 8 AND k < 12")
def get_block_by_place(spark, sf):
    return get_block(table(spark, sf, "nation"), 2, 4)


@query("SELECT CAST(c_custkey AS INTEGER) AS A1, c_nationkey AS A2 FROM customer")
def dat_round_trip(spark, sf):
    """Writes a fixed-width integer table and reads it back."""
    register(spark)
    path = folder(spark)
    table(spark, sf, "customer").select(F.col("c_custkey").cast("int"), "c_nationkey").write.format("dat").mode("append").save(path)
    return spark.read.format("dat").load(path)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_cols(spark, sf):
    return project(table(spark, sf, "orders"), ["o_orderkey", 3])


@query("SELECT * FROM orders WHERE o_custkey = 42")
def restrict_eq(spark, sf):
    return restrict(table(spark, sf, "orders"), "o_custkey", "42", "==")


@query("SELECT * FROM customer WHERE c_nationkey != 7")
def restrict_ne(spark, sf):
    return restrict(table(spark, sf, "customer"), "c_nationkey", 7, "!=")


@query("SELECT * FROM orders WHERE o_totalprice > 300000")
def restrict_gt(spark, sf):
    return restrict(table(spark, sf, "orders"), "A4", 300000, ">")


@query("SELECT * FROM part WHERE p_size < 5")
def restrict_lt(spark, sf):
    return restrict(table(spark, sf, "part"), "p_size", 5, "<")


@query("SELECT * FROM part WHERE p_size >= 45")
def restrict_ge(spark, sf):
    return restrict(table(spark, sf, "part"), "p_size", 45, ">=")


@query("SELECT * FROM supplier WHERE s_acctbal <= 0")
def restrict_le(spark, sf):
    return restrict(table(spark, sf, "supplier"), "s_acctbal", 0, "<=")


@query("SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'R'")
def restrict_chain(spark, sf):
    return conjunction(table(spark, sf, "lineitem"), [("l_quantity", ">=", 10), ("l_quantity", "<=", 20), ("l_returnflag", "=", "R")])


@query("SELECT * FROM lineitem WHERE l_tax > l_discount")
def restrict_columns(spark, sf):
    return compare_columns(table(spark, sf, "lineitem"), "l_tax", ">", "l_discount")


def _orders_customers(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        orders = project(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"])
        customers = project(table(spark, sf, "customer"), ["c_custkey", "c_name"])
        return project(join(orders, customers, ("o_custkey", "c_custkey"), strategy), ["o_orderkey", "c_custkey", "c_name"])

    return run


for _strategy in ("auto", "hash", "sort_merge", "broadcast"):
    QUERIES[f"join_{_strategy}"] = _orders_customers(_strategy)
    ORACLES[f"join_{_strategy}"] = "SELECT o.o_orderkey, c.c_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


@query("SELECT n.*, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_nested_loop(spark, sf):
    return join(table(spark, sf, "nation"), table(spark, sf, "region"), ("n_regionkey", "r_regionkey"), "nested_loop")


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_index(spark, sf):
    """Both sides bucketed on the key: no exchange."""
    orders = HashLayout(8).build(table(spark, sf, "orders"), "o_custkey")
    layout = HashLayout(8).build(table(spark, sf, "customer"), "c_custkey")
    return project(index_join(orders.table(), layout, "o_custkey"), ["o_orderkey", "c_name"])


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_acctbal < c.c_acctbal")
def join_conditions(spark, sf):
    joined = join(table(spark, sf, "supplier"), table(spark, sf, "customer"), [("s_nationkey", "=", "c_nationkey"), ("s_acctbal", "<", "c_acctbal")])
    return project(joined, ["s_suppkey", "c_custkey"])


@query("SELECT a.n_name AS n_name, b.n_name AS n_name_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(spark, sf):
    nation = table(spark, sf, "nation")
    return project(join(nation, nation, ("n_regionkey", "n_regionkey")), ["n_name", "n_name_2"])


@query("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_acctbal > 0")
def join_three(spark, sf):
    customers = restrict(table(spark, sf, "customer"), "c_acctbal", 0, ">")
    joined = join_all([customers, table(spark, sf, "nation"), table(spark, sf, "region")], [("c_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")])
    return project(joined, ["c_custkey", "n_name", "r_name"])


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000 AND o_totalprice > 100000")
def join_filter_both(spark, sf):
    catalog = Catalog(spark)
    catalog.register("orders", table(spark, sf, "orders"))
    catalog.register("customer", table(spark, sf, "customer"))
    where = [("o_custkey", "=", Ref("c_custkey")), ("c_acctbal", ">", 5000), ("o_totalprice", ">", 100000)]
    return catalog.query(["o_orderkey", "c_name"], ["orders", "customer"], where)


@query("SELECT o_custkey AS A2, c_name AS A2_2 FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 100000")
def dialect_positional(spark, sf):
    catalog = Catalog(spark)
    catalog.positional("ORDERS", table(spark, sf, "orders"))
    catalog.positional("CUSTOMER", table(spark, sf, "customer"))
    where = [("ORDERS.A2", "=", Ref("CUSTOMER.A1")), ("orders.a4", ">", "100000")]
    return catalog.query(["ORDERS.A2", 7], ["ORDERS", "CUSTOMER"], where)


@query("SELECT o_orderstatus AS A3, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def dialect_sql_text(spark, sf):
    catalog = Catalog(spark)
    catalog.positional("ORDERS_P", table(spark, sf, "orders"))
    return catalog.sql("SELECT ORDERS_P.A3, COUNT(*) AS n FROM ORDERS_P WHERE ORDERS_P.A4 > 1000 GROUP BY ORDERS_P.A3")


@query("SELECT CAST(coalesce(SUM(p_size), 0) AS BIGINT) AS sum_p_size FROM part")
def agg_sum_int(spark, sf):
    return aggregate(table(spark, sf, "part"), "p_size", "SUM")


@query("SELECT round(coalesce(SUM(l_quantity), 0), 2) AS s FROM lineitem")
def agg_sum_double(spark, sf):
    return aggregate(table(spark, sf, "lineitem"), "l_quantity", "SUM", name="s").select(F.round("s", 2).alias("s"))


@query("SELECT AVG(CAST(p_size AS DOUBLE)) AS a FROM part")
def agg_avg(spark, sf):
    return aggregate(table(spark, sf, "part"), "p_size", "AVG", name="a")


@query("SELECT MIN(o_totalprice) AS m FROM orders")
def agg_min(spark, sf):
    return aggregate(table(spark, sf, "orders"), "o_totalprice", "MIN", name="m")


@query("SELECT MAX(o_totalprice) AS m FROM orders")
def agg_max(spark, sf):
    return aggregate(table(spark, sf, "orders"), "o_totalprice", "max", name="m")


@query("SELECT COUNT(*) AS n FROM lineitem")
def agg_count(spark, sf):
    return aggregate(table(spark, sf, "lineitem"), "*", "COUNT", name="n")


@query("SELECT CAST(coalesce(SUM(o_custkey), 0) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def agg_empty_sum(spark, sf):
    return aggregate(restrict(table(spark, sf, "orders"), "o_orderkey", 0, "<"), "o_custkey", "SUM", name="s")


@query("SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_custkey")
def agg_group_empty(spark, sf):
    return aggregate(restrict(table(spark, sf, "orders"), "o_orderkey", 0, "<"), "*", "COUNT", ["o_custkey"], "n")


@query("SELECT l_returnflag, l_linestatus, round(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_multi(spark, sf):
    grouped = aggregate(table(spark, sf, "lineitem"), "l_extendedprice", "SUM", ["l_returnflag", "l_linestatus"], "s")
    return grouped.withColumn("s", F.round("s", 2))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def agg_group_count(spark, sf):
    return aggregate(table(spark, sf, "orders"), "*", "COUNT", ["o_custkey"], "n")


def _lineitem_layout(spark: SparkSession, sf: str) -> RangeLayout:
    return RangeLayout(folder(spark), block_bytes=1 << 20).build(table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT * FROM lineitem WHERE l_partkey >= 10 AND l_partkey <= 20")
def index_range(spark, sf):
    return index_scan(_lineitem_layout(spark, sf), 10, high=20)


@query("SELECT * FROM lineitem WHERE l_partkey < 3")
def index_below(spark, sf):
    return get_with_index(_lineitem_layout(spark, sf), 3, "<")


@query("SELECT * FROM lineitem WHERE l_partkey = 42")
def index_point_hash(spark, sf):
    return index_scan(HashLayout(10).build(table(spark, sf, "lineitem"), "l_partkey"), 42)


@query("SELECT * FROM lineitem WHERE l_partkey = 42")
def index_point_adaptive(spark, sf):
    return get_with_index(AdaptiveHashLayout(10_000).build(table(spark, sf, "lineitem"), "l_partkey"), 42)


@query("SELECT * FROM lineitem WHERE l_partkey >= 40 AND l_partkey <= 42")
def index_blocks(spark, sf):
    index = BlockIndex(f"{sf}/lineitem.parquet", folder(spark), 256)
    return index_scan(index.build(table(spark, sf, "lineitem"), "l_partkey"), 40, high=42)


@query("SELECT key, block FROM (SELECT DISTINCT l_partkey AS key, (row_number() OVER () - 1) // 256 AS block FROM lineitem) ORDER BY key, block LIMIT 5 OFFSET 10")
def index_entries(spark, sf):
    """Entries of the block index by place, half-open."""
    index = BlockIndex(f"{sf}/lineitem.parquet", folder(spark), 256)
    index.build(table(spark, sf, "lineitem"), "l_partkey")
    return index.scan_range(10, 15).select("key", "block")


@query("SELECT * FROM part WHERE p_size = 7")
def layout_reopened(spark, sf):
    """A layout built at a path and opened again under another name."""
    path = folder(spark)
    HashLayout(4, path=path).build(table(spark, sf, "part"), "p_size")
    return index_scan(HashLayout.open(spark, path), 7)


@query("SELECT count(*) AS n_rows, count(DISTINCT p_size) AS n_keys FROM part")
def layout_stats(spark, sf):
    """Rows and keys of the files of a hash layout: a key is in one file."""
    stats = HashLayout(4).build(table(spark, sf, "part"), "p_size").stats()
    return stats.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 500")
def rows_of_several_files(spark, sf):
    """Rows by place of a table of several files."""
    path = folder(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return rows_between(spark.read.parquet(path), 500, 510)


def _dat_customers(spark: SparkSession, sf: str) -> str:
    register(spark)
    path = folder(spark)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").cast("int"), "c_nationkey")
    customers.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").write.format("dat").mode("append").save(path)
    return path


@query("SELECT CAST(c_custkey AS INTEGER) AS A1, c_nationkey AS A2 FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 70")
def dat_tuple_by_place(spark, sf):
    return get_dat_tuple(spark, _dat_customers(spark, sf), 70)


@query("SELECT CAST(c_custkey AS INTEGER) AS A1, c_nationkey AS A2 FROM customer ORDER BY c_custkey LIMIT 8 OFFSET 40")
def dat_block_by_place(spark, sf):
    return get_dat_block(spark, _dat_customers(spark, sf), 5, 8)


@query("SELECT 500 AS n_rows, true AS within")
def random_rows(spark, sf):
    made = random_table(spark, 3, 7, 500, seed=1)
    inside = F.bool_and((F.col("A1") >= 0) & (F.col("A1") < 7) & (F.col("A3") >= 0) & (F.col("A3") < 7))
    return made.agg(F.count("*").cast("int").alias("n_rows"), inside.alias("within"))


@query(
    "SELECT CAST(i AS INTEGER) AS A1, CAST((i + 43) * 1103515245 % 2147483647 // 65536 % 1000 AS INTEGER) AS A2, CAST((i + 43) * 1103539935 % 2147483647 // 65536 % 50 AS INTEGER) AS A3 FROM range(2000) AS t(i)"
)
def seeded_rows(spark, sf):
    return seeded_table(spark, 2000, (1000, 50))


@query("SELECT n.*, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")
def query_star(spark, sf):
    catalog = Catalog(spark)
    for name in ("nation", "region"):
        catalog.register(name, table(spark, sf, name))
    return catalog.query("*", ["nation", "region"], [("n_regionkey", "=", Ref("r_regionkey")), ("r_name", "!=", "ASIA")])


@query("SELECT o_orderstatus, COUNT(*) AS count_all, MAX(o_custkey) AS max_o_custkey FROM orders GROUP BY o_orderstatus")
def query_aggregates(spark, sf):
    """Several aggregates in one query; the keys come first."""
    catalog = Catalog(spark)
    catalog.register("orders", table(spark, sf, "orders"))
    return catalog.query([("COUNT", "*"), ("MAX", "o_custkey")], ["orders"], group_by=["o_orderstatus"])


@query("SELECT DISTINCT o_orderpriority FROM orders")
def query_group_only(spark, sf):
    """GROUP BY without an aggregate gives each group once."""
    catalog = Catalog(spark)
    catalog.register("orders", table(spark, sf, "orders"))
    return catalog.query(["o_orderpriority"], ["orders"], group_by=["o_orderpriority"])


@query("SELECT * FROM (VALUES ('comparison', true), ('cross product', true), ('unbuilt layout', true), ('relation', true), ('column', true), ('aggregate', true)) AS t(what, refused)")
def refusals(spark, sf):
    """What is an error: unknown comparisons, relations, columns and aggregates, cross products, layouts that are not built."""
    nation, catalog = table(spark, sf, "nation"), Catalog(spark)
    for name in ("nation", "region"):
        catalog.register(name, table(spark, sf, name))
    tries = {
        "comparison": (ValueError, lambda: restrict(nation, "n_nationkey", 1, "~")),
        "cross product": (QueryError, lambda: catalog.query("*", ["nation", "region"])),
        "unbuilt layout": (RuntimeError, lambda: index_scan(HashLayout(), 1)),
        "relation": (QueryError, lambda: catalog.query("*", ["nowhere"])),
        "column": (QueryError, lambda: catalog.query(["nation.A9"], ["nation"])),
        "aggregate": (ValueError, lambda: aggregate(nation, "n_nationkey", "MODE")),
    }
    found = []
    for what, (kind, run) in tries.items():
        try:
            run()
            found.append((what, False))
        except kind:
            found.append((what, True))
    return spark.createDataFrame(found, "what string, refused boolean")


@query("SELECT true AS has_join, true AS has_filter, true AS root_first")
def plan_lines(spark, sf):
    """The plan of a query as text."""
    lines = summary(QUERIES["join_filter_both"](spark, sf)).split("\n")
    found = ("Join" in " ".join(lines), any("Filter" in x for x in lines), not lines[0].startswith(" "))
    return spark.createDataFrame([found], "has_join boolean, has_filter boolean, root_first boolean")


@query("SELECT 'NATION_OF_SHELL (3 columns)' AS tables, true AS again_refused, true AS rows_shown, true AS ended")
def shell_session(spark, sf):
    shell = Shell(spark)
    shell.run(f"LOAD nation_of_shell {sf}/nation.parquet")
    again = "already" in shell.run(f"LOAD nation_of_shell {sf}/nation.parquet")
    shown = "KENYA" in (shell.run("SELECT 'KENYA' AS k FROM nation_of_shell WHERE n_nationkey = 1") or "")
    return spark.createDataFrame([(shell.run("TABLES"), again, shown, shell.run("EXIT") is None)], "tables string, again_refused boolean, rows_shown boolean, ended boolean")


@query("SELECT count(*) AS tuples, count(*) * 2 AS cells FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000")
def measured_query(spark, sf):
    """What an action observes of its result: rows, and cells."""
    _, stats = measured(QUERIES["join_filter_both"](spark, sf), lambda df: df.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([(stats.tuples, stats.cells)], "tuples long, cells long")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def stream_group_count(spark, sf):
    """The same operators over a stream of files, until all that is there is read."""
    path, name = folder(spark), f"stream_{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    orders.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(orders.schema).parquet(path)
    stream_to(aggregate(restrict(stream, "o_totalprice", 1000, ">"), "*", "COUNT", ["o_orderstatus"], "n"), name, folder(spark), "complete").awaitTermination()
    return spark.table(name)
