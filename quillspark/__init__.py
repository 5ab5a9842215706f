"""Review-topic analytics on Spark DataFrames."""
