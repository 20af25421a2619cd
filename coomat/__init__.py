"""Matrix and graph analytics on Spark DataFrames."""
