"""Document-to-artifact analytics on Spark DataFrames."""
