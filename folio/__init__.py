"""Document analytics over Spark DataFrames."""
