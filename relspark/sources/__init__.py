"""Sources and sinks: fixed-width integer files, in-memory and random tables, rows by place."""

from relspark.sources.dat import DatSource, register
from relspark.sources.tables import get_block, get_dat_block, get_dat_tuple, get_tuple, random_table, rows_between, seeded_table, table_of

__all__ = ["DatSource", "get_block", "get_dat_block", "get_dat_tuple", "get_tuple", "random_table", "register", "rows_between", "seeded_table", "table_of"]
