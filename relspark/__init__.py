"""relspark: relational operators, sources and physical layouts expressed as Spark DataFrames."""
