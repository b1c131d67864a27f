"""Columns by name or place, and comparisons with literals.

A column is given as an int (place from 0), as "An" (place from 1) or by its name; a name that the relation
has goes before the reading as "An".
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS: dict[str, Callable] = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
    ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le,
}
#: The comparisons that hold with their sides exchanged, where these are others.
FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


def place_of(names: list[str], ref: int | str) -> int:
    """The place of a column among the names; LookupError if there is none."""
    if isinstance(ref, bool) or not isinstance(ref, int | str):
        raise TypeError(f"a column is given by an int or a name, not by {ref!r}")
    if isinstance(ref, str):
        exact = [k for k, x in enumerate(names) if x == ref] or [k for k, x in enumerate(names) if x.lower() == ref.lower()]
        if len(exact) == 1:
            return exact[0]
        if exact:
            raise LookupError(f"{ref} is the name of several columns")
        if not (m := re.fullmatch(r"[aA]([1-9]\d*)", ref)):
            raise LookupError(f"no column {ref} among {names}")
        ref = int(m[1]) - 1
    if not 0 <= ref < len(names):
        raise LookupError(f"no column {ref} among {len(names)}")
    return ref


def column_of(df: DataFrame, ref: int | str) -> Column:
    return df[f"`{df.columns[place_of(df.columns, ref)].replace('`', '``')}`"]


def as_literal(value: object, kind: T.DataType) -> object:
    """A quoted number is a number where it is compared with a number column; else the value as it is."""
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        for read in (int, float):
            try:
                return read(value)
            except ValueError:
                pass
    return value


def comparison(df: DataFrame, ref: int | str, op: str, value: object) -> Column:
    """The column compared with a literal. A text that is no number equals no number: "=" holds for no row, "!=" for every one."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    column, kind = column_of(df, ref), df.schema[place_of(df.columns, ref)].dataType
    value = as_literal(value, kind)
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        if COMPARISONS[op] is operator.eq:
            return F.lit(False)
        if COMPARISONS[op] is operator.ne:
            return column.isNotNull()
        raise TypeError(f"{value!r} can't be ordered against numbers")
    return COMPARISONS[op](column, F.lit(value))
