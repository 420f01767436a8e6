"""Script-aware page analytics on Spark DataFrames."""
