"""lexsieve: indexed text search and corpus processing on Spark DataFrames."""
