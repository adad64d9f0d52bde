"""Change-data analytics on Spark DataFrames."""
