"""Projection, restriction, joins and aggregation, left to Catalyst and adaptive execution."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions.positional import COMPARISONS, column_of, comparison, place_of
from relspark.shared import shared_folder

#: Join algorithms by name and the hints that ask Spark for them; "auto" leaves the choice to Spark.
STRATEGIES = {"auto": None, "nested_loop": "shuffle_replicate_nl", "hash": "shuffle_hash", "broadcast": "broadcast", "sort_merge": "merge"}
#: The largest estimated right side, in bytes, that "broadcast" sends to every executor; beyond it the choice is Spark's.
BROADCAST_BYTES = 256 << 20
#: A join with "<" and the like is dealt into blocks if rows of equal keys make more pairs than PAIRS, which is also about what a task
#: compares. A block has about BLOCK rows of a key, and a task reads about DEALT rows at most.
PAIRS, BLOCK, DEALT = 1 << 23, 2048, 1 << 20
#: The numbers of blocks of up to so many keys of several blocks are broadcast; of more, they are a table in the shared folder.
FEW = 10_000
AGGREGATES = ("SUM", "AVG", "MIN", "MAX", "COUNT")


def project(df: DataFrame, columns: Sequence[int | str]) -> DataFrame:
    """The columns in the order given; rows stay a bag, a column may be given twice."""
    return df.select(*[column_of(df, c) for c in columns])


def restrict(df: DataFrame, column: int | str, value: object, op: str = "==") -> DataFrame:
    """The rows whose column compares with the literal."""
    return df.filter(comparison(df, column, op, value))


def conjunction(df: DataFrame, conditions: Sequence[tuple[int | str, str, object]]) -> DataFrame:
    """The rows that meet every (column, op, literal)."""
    for column, op, value in conditions:
        df = restrict(df, column, value, op)
    return df


def compare_columns(df: DataFrame, left: int | str, op: str, right: int | str) -> DataFrame:
    """The rows whose two columns compare."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return df.filter(COMPARISONS[op](column_of(df, left), column_of(df, right)))


def _apart(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides under names of their own, and the names of the result (of equal ones the right gets a suffix)."""
    n, names = len(left.columns), list(left.columns)
    for name in right.columns:
        k, free = 2, name
        while free.lower() in {x.lower() for x in names}:
            free, k = f"{name}_{k}", k + 1
        names.append(free)
    return left.toDF(*[f"l{k}" for k in range(n)]), right.toDF(*[f"r{k}" for k in range(len(right.columns))]), names


def join(
    left: DataFrame, right: DataFrame, on: tuple[int | str, int | str] | Sequence[tuple[int | str, str, int | str]], strategy: str = "auto"
) -> DataFrame:
    """Inner join; the left columns, then the right ones, both keys kept.

    on: one pair of columns, or (left column, comparison, right column) conditions that all hold. "broadcast" holds
    if Spark's estimate of the right side is within BROADCAST_BYTES, else the choice is left to Spark.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    conditions = [(on[0], "=", on[1])] if len(on) == 2 and not isinstance(on[0], tuple) else list(on)
    if not conditions:
        raise ValueError("a join needs a condition; cross products are not made")
    apart_l, apart_r, names = _apart(left, right)
    placed = [(apart_l.columns[place_of(left.columns, a)], op, apart_r.columns[place_of(right.columns, b)]) for a, op, b in conditions]
    return join_named(apart_l, apart_r, placed, strategy).toDF(*names)


def join_named(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], strategy: str = "auto") -> DataFrame:
    """Inner join of two relations without a common name on (left name, comparison, right name) conditions.

    With comparisons other than "=" the pairs of a key grow with the square of its rows and all meet in one task. Beyond PAIRS
    the rows are dealt into blocks, and each pair of blocks of a key is joined by itself (see _dealt). That takes a count of the keys'
    rows first. Joins on "=" alone, "broadcast", "nested_loop" and streams are left to Spark.
    """
    for _, op, _ in conditions:
        if op not in COMPARISONS:
            raise ValueError(f"unknown comparison {op!r}")
    hint = STRATEGIES[strategy]
    if strategy == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        hint = None
    joined = left.join(right.hint(hint) if hint else right, _all(COMPARISONS[op](left[a], right[b]) for a, op, b in conditions))
    equal = [(a, b) for a, op, b in conditions if COMPARISONS[op] is operator.eq]
    if len(equal) == len(conditions) or strategy in ("broadcast", "nested_loop") or left.isStreaming or right.isStreaming:
        return joined
    kinds = [_common_kind(left.select(a), right.select(b)) for a, b in equal]
    if None in kinds:
        return joined
    return _dealt(left, right, conditions, kinds, hint or "merge") or joined


def _all(conditions) -> Column:
    return reduce(operator.and_, conditions)


def _common_kind(left: DataFrame, right: DataFrame) -> T.DataType | None:
    """The type in which two columns are compared, if they have the same or are both numbers."""
    one, other = left.schema[0].dataType, right.schema[0].dataType
    if one == other:
        return one
    return left.union(right).schema[0].dataType if isinstance(one, T.NumericType) and isinstance(other, T.NumericType) else None


def _keyed(df: DataFrame, columns: Sequence[str], equal: Sequence[str], kinds: Sequence[T.DataType]) -> DataFrame:
    """The rows that can meet any (no null in the compared columns), with the keys as __k0, ... (fractions as text, in which 0 has no sign)."""
    keys = [df[c].cast(kind) for c, kind in zip(equal, kinds, strict=True)]
    keys = [(k + F.lit(0.0)).cast("string") if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else k for k, kind in zip(keys, kinds, strict=True)]
    return df.filter(_all(df[c].isNotNull() for c in columns)).withColumns({f"__k{i}": k for i, k in enumerate(keys)})


def _dealt(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], kinds: Sequence[T.DataType], hint: str) -> DataFrame | None:
    """The join by pairs of blocks, None if rows of equal keys make no more than PAIRS pairs.

    A key's rows of either side are dealt into blocks of about BLOCK rows by a hash of the whole row (exact copies of a row stay
    together); a row goes once to each block of the other side, so each pair of rows meets once. The number of tasks grows with
    the pairs, and a row is sent as often as the other side has blocks of its key.
    """
    equal = [(a, b) for a, op, b in conditions if COMPARISONS[op] is operator.eq]
    keyed_l = _keyed(left, [a for a, _, _ in conditions], [a for a, _ in equal], kinds)
    keyed_r = _keyed(right, [b for _, _, b in conditions], [b for _, b in equal], kinds)
    keys = [f"__k{i}" for i in range(len(equal))]
    rows = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    counts_l, counts_r = rows(keyed_l, "__nl"), rows(keyed_r, "__nr")
    sizes = (counts_l.join(counts_r, keys, "full") if keys else counts_l.crossJoin(counts_r)).fillna(0, ["__nl", "__nr"])
    sizes = sizes.withColumns({f"__b{x}": F.greatest(F.ceil(F.col(f"__n{x}") / BLOCK), F.lit(1)) for x in "lr"})
    total = lambda a, b: F.coalesce(F.sum(F.col(a).cast("double") * F.col(b)), F.lit(0.0))
    several = "__nl > 0 and __nr > 0 and __bl * __br > 1"
    pairs, sent_l, sent_r, n_split = sizes.agg(total("__nl", "__nr"), total("__nl", "__br"), total("__nr", "__bl"), F.count_if(F.expr(several))).first()
    if pairs <= PAIRS:
        return None
    spark = left.sparkSession
    split = sizes.filter(several).select(*keys, "__bl", "__br")  # fixed once, so that both sides are dealt alike
    if n_split <= FEW and all(isinstance(kind, T.NumericType | T.StringType | T.DateType | T.BooleanType) for kind in kinds):
        split = F.broadcast(spark.createDataFrame(split.collect(), split.schema))
    else:
        shared_folder(spark)
        split = split.checkpoint()
    tasks = max(math.ceil(pairs / PAIRS), math.ceil((sent_l + sent_r) / DEALT), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, columns: list[str], sent: float, own: str, others: str, n_own: str, n_others: str) -> DataFrame:
        hashed = [f.name for f in df.schema if f.name in columns and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        df = df.withColumn("__h", F.xxhash64(*hashed))
        if sent > DEALT:
            df = df.repartition(math.ceil(sent / DEALT), "__h")
        df = df.join(split, keys or F.lit(True), "left")
        block = F.pmod(F.col("__h"), F.coalesce(n_own, F.lit(1))).alias(own)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n_others, F.lit(1)) - 1)).alias(others)
        # one column: the optimizer would drop a key that is constant from the join and exchange the rows again; it does so too if
        # the two sides' types differ in what can be null
        cell = F.struct(*[F.when(F.col(c).isNotNull(), F.col(c)).alias(c) for c in [*keys, "__i", "__j"]]).alias("__cell")
        return df.select(*columns, *keys, block, each).select(*columns, cell).repartition(tasks, "__cell")

    one = dealt(keyed_l, left.columns, sent_l, "__i", "__j", "__bl", "__br")
    other = dealt(keyed_r, right.columns, sent_r, "__j", "__i", "__br", "__bl")
    met = [one["__cell"] == other["__cell"]] + [COMPARISONS[op](one[a], other[b]) for a, op, b in conditions if COMPARISONS[op] is not operator.eq]
    return one.join(other.hint(hint), _all(met)).select(*[one[c] for c in left.columns], *[other[c] for c in right.columns])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a relation's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_all(relations: Sequence[DataFrame], on: Sequence[tuple[int | str, int | str]], strategy: str = "auto") -> DataFrame:
    """A left-deep chain: relation k + 1 joins all before it on on[k] (its first column is one of the joined relation)."""
    if len(on) != len(relations) - 1:
        raise ValueError("each relation after the first needs a condition")
    out = relations[0]
    for right, pair in zip(relations[1:], on, strict=True):
        out = join(out, right, pair, strategy)
    return out


def aggregate(df: DataFrame, column: int | str, func: str, group_by: Sequence[int | str] | None = None, name: str | None = None) -> DataFrame:
    """One aggregate of a column ("*" for COUNT), for all rows or for each group: the keys, then the aggregate.

    Without groups there is one row, 0 if there is no input (for MIN and MAX of columns that aren't numbers: null).
    """
    func = func.upper()
    if func not in AGGREGATES:
        raise ValueError(f"unknown aggregate {func}; there are {', '.join(AGGREGATES)}")
    source = column_of(df, 0 if column == "*" else column)
    kind = df.schema[0 if column == "*" else place_of(df.columns, column)].dataType
    value = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": lambda _: F.count(F.lit(1))}[func](source)
    name = name or f"{func.lower()}_{'all' if column == '*' else df.columns[place_of(df.columns, column)]}"
    if group_by:
        keys = [column_of(df, k) for k in group_by]
        return df.groupBy(*keys).agg(value.alias(name))
    if isinstance(kind, T.NumericType) and func != "COUNT":
        value = F.coalesce(value, F.lit(0))
    return df.agg(value.alias(name))
