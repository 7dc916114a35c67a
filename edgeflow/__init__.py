"""edgeflow: graph analytics on Spark DataFrames."""
