"""Session-log analytics on Spark DataFrames."""
