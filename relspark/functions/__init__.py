"""Column references and literals of positional relations."""

from relspark.functions.positional import as_literal, column_of, comparison

__all__ = ["as_literal", "column_of", "comparison"]
