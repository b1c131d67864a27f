"""Named relations and layouts: queries given by parts, and SQL text, which is Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions.positional import COMPARISONS, FLIPPED, as_literal, place_of
from relspark.operators.relational import AGGREGATES, join_named
from relspark.plans.layouts import Layout


class QueryError(ValueError):
    """A query that names what isn't there, or asks for a cross product."""


class _Scope:
    """The columns of the relations of a query, by place in the joined row."""

    def __init__(self, tables: list[tuple[str, DataFrame]]) -> None:
        self.tables, self.columns = {}, []
        for alias, df in tables:
            if alias in self.tables:
                raise QueryError(f"{alias} is named twice; give one an alias")
            self.tables[alias] = (len(self.columns), list(df.columns))
            self.columns += [(alias, k, name, df.schema[k].dataType) for k, name in enumerate(df.columns)]

    def find(self, ref: int | str) -> int:
        """T.An, T.k (k from 0), T.name; for the joined row An, k, or a name that one relation alone has."""
        try:
            if isinstance(ref, str) and "." in ref:
                alias, _, column = ref.partition(".")
                if alias.upper() not in self.tables:
                    raise QueryError(f"no relation {alias} in the query")
                start, names = self.tables[alias.upper()]
                return start + place_of(names, int(column) if column.isdigit() else column)
            if isinstance(ref, str):
                same = [k for k, c in enumerate(self.columns) if c[2].lower() == ref.lower()]
                by_place = ref[:1] in "aA" and ref[1:].isdigit()
                if len(same) == 1 and not (by_place and len(self.tables) > 1):
                    return same[0]
                if len(same) > 1 and not by_place:
                    raise QueryError(f"{ref} is a column of several relations")
            return place_of(["" for _ in self.columns], ref)
        except LookupError as e:
            raise QueryError(str(e)) from None

    def column(self, place: int) -> Column:
        return F.col(f"c{place}")


class Catalog:
    """Relations by name, in any case. A relation is also a temporary view, so SQL text sees it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._layouts: dict[tuple[str, int], Layout] = {}

    def register(self, name: str, df: DataFrame, names: Sequence[str] | None = None) -> None:
        """names: new column names; with positional() these are A1, A2, ..."""
        df = df.toDF(*names) if names else df
        self._tables[name.upper()] = df
        df.createOrReplaceTempView(name)

    def positional(self, name: str, df: DataFrame) -> None:
        self.register(name, df, [f"A{k + 1}" for k in range(len(df.columns))])

    def table(self, name: str) -> DataFrame:
        if name.upper() not in self._tables:
            raise QueryError(f"no relation {name}")
        return self._tables[name.upper()]

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def arity(self, name: str) -> int:
        return len(self.table(name).columns)

    def size(self, name: str) -> int:
        return self.table(name).count()

    def register_layout(self, name: str, column: int | str, layout: Layout) -> None:
        self._layouts[name.upper(), place_of(self.table(name).columns, column)] = layout

    def layout(self, name: str, column: int | str) -> Layout | None:
        return self._layouts.get((name.upper(), place_of(self.table(name).columns, column)))

    def sql(self, text: str) -> DataFrame:
        """SQL text over the registered relations, with all that Spark's SQL has."""
        return self.spark.sql(text)

    def query(
        self,
        select: Sequence[int | str | tuple[str, int | str]],
        tables: Sequence[str | tuple[str, str]],
        where: Sequence[tuple[int | str, str, object]] = (),
        group_by: Sequence[int | str] = (),
    ) -> DataFrame:
        """A query by its parts.

        select: "*", columns, or (function, column or "*") aggregates; the result has the keys, then the aggregates.
        tables: names or (name, alias); joined in this order, each on a condition with one before it.
        where: (column, comparison, value); a value Ref("T.A1") is a column. All must hold.
        An aggregate of no rows without group_by is 0; group_by without an aggregate gives each group once.
        """
        named = [(t[1].upper(), self.table(t[0])) if isinstance(t, tuple) else (t.upper(), self.table(t)) for t in tables]
        scope = _Scope(named)
        parts = [df.toDF(*[f"c{scope.tables[alias][0] + k}" for k in range(len(df.columns))]) for alias, df in named]
        pairs = [(scope.find(a), op, scope.find(v.name)) for a, op, v in where if isinstance(v, Ref)]
        for a, op, v in where:
            if op not in COMPARISONS:
                raise QueryError(f"unknown comparison {op!r}")
            if not isinstance(v, Ref):
                k = scope.find(a)
                owner = list(scope.tables).index(scope.columns[k][0])
                parts[owner] = parts[owner].filter(_compare(scope, k, op, v))
        joined, width = parts[0], len(parts[0].columns)
        waiting = list(pairs)
        for part in [None, *parts[1:]]:
            upto = width + (len(part.columns) if part else 0)
            now = [p for p in waiting if max(p[0], p[2]) < upto]
            waiting = [p for p in waiting if p not in now]
            across = [(f"c{a}", op, f"c{b}") if a < b else (f"c{b}", FLIPPED.get(op, op), f"c{a}") for a, op, b in now if (a < width) != (b < width)]
            if part is not None:
                if not across:
                    raise QueryError("a relation has no condition with those before it; cross products are not made")
                own = [p for p in now if (p[0] < width) == (p[2] < width)]
                for a, op, b in own:
                    part = part.filter(COMPARISONS[op](scope.column(a), scope.column(b)))
                joined, width = join_named(joined, part, across), upto
                continue
            for a, op, b in now:
                joined = joined.filter(COMPARISONS[op](scope.column(a), scope.column(b)))
        return self._output(joined, scope, list(select), list(group_by))

    def _output(self, joined: DataFrame, scope: _Scope, select: list, group_by: list) -> DataFrame:
        names = lambda places: _unique([scope.columns[k][2] for k in places])
        aggregates = [x for x in select if isinstance(x, tuple)]
        keys = [scope.find(g) for g in group_by]
        if aggregates:
            values, labels = [], []
            for func, ref in aggregates:
                func, place = func.upper(), 0 if ref == "*" else scope.find(ref)
                if func not in AGGREGATES:
                    raise QueryError(f"unknown aggregate {func}")
                column = scope.column(place)
                value = F.count(F.lit(1)) if func == "COUNT" else getattr(F, func.lower())(column)
                if not keys and func != "COUNT" and isinstance(scope.columns[place][3], T.NumericType):
                    value = F.coalesce(value, F.lit(0))
                values.append(value)
                labels.append(f"{func.lower()}_{'all' if ref == '*' else scope.columns[place][2]}")
            out = joined.groupBy(*map(scope.column, keys)).agg(*[v.alias(f"v{k}") for k, v in enumerate(values)]) if keys else joined.agg(*[v.alias(f"v{k}") for k, v in enumerate(values)])
            return out.toDF(*_unique([scope.columns[k][2] for k in keys] + labels))
        places = list(range(len(scope.columns))) if "*" in select else [scope.find(x) for x in select]
        if keys:
            if set(places) - set(keys):
                raise QueryError("a selected column is not grouped by")
            joined = joined.select(*map(scope.column, dict.fromkeys(keys))).distinct()
        return joined.select(*map(scope.column, places)).toDF(*names(places))


class Ref:
    """A column on the right of a comparison."""

    def __init__(self, name: int | str) -> None:
        self.name = name


def _compare(scope: _Scope, place: int, op: str, value: object) -> Column:
    kind = scope.columns[place][3]
    value = as_literal(value, kind)
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        if op in ("=", "=="):
            return F.lit(False)
        if op in ("!=", "<>"):
            return scope.column(place).isNotNull()
        raise QueryError(f"{value!r} can't be ordered against numbers")
    return COMPARISONS[op](scope.column(place), F.lit(value))


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        k, free = 2, name
        while free.lower() in {x.lower() for x in out}:
            free, k = f"{name}_{k}", k + 1
        out.append(free)
    return out
