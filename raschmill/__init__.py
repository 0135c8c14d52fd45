"""Item response analytics on Spark DataFrames."""
