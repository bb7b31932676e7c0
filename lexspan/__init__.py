"""lexspan: citation analytics on Spark DataFrames."""
