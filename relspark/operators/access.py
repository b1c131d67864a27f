"""Access through a layout (relspark.plans.layouts): points and ranges.

The predicate is pushed to the layout's scan and evaluated again on every row that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from relspark.plans.layouts import Layout


def index_scan(layout: Layout, value: object, op: str = "==", high: object | None = None) -> DataFrame:
    """The rows whose indexed column compares with the value, or lies in [value, high].

    TypeError for ranges of a layout that has points only, ValueError for comparisons that no layout serves.
    """
    if high is not None:
        return layout.range_search(value, high)
    if op in ("=", "=="):
        return layout.search(value)
    if op == ">=":
        return layout.range_search(value, None)
    if op == "<=":
        return layout.range_search(None, value)
    if op == ">":
        return layout.range_search(value, None, open_low=True)
    if op == "<":
        return layout.range_search(None, value, open_high=True)
    raise ValueError(f"comparison {op!r} is not served by a layout")


def get_with_index(layout: Layout, value: object, op: str = "==", high: object | None = None) -> DataFrame:
    """The same access under its second name."""
    return index_scan(layout, value, op, high)
