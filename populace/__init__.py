"""Population-gating analytics on Spark DataFrames."""
