"""Relational operators: functions from DataFrames to DataFrames."""

from relspark.operators.access import get_with_index, index_scan
from relspark.operators.relational import aggregate, compare_columns, conjunction, join, join_all, project, restrict

__all__ = ["aggregate", "compare_columns", "conjunction", "get_with_index", "index_scan", "join", "join_all", "project", "restrict"]
