"""Route-restriction analytics on Spark DataFrames."""
