"""Event-to-state analytics on Spark DataFrames."""
