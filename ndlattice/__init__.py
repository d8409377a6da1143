"""N-dimensional array analytics on Spark DataFrames."""
