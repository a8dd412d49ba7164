"""Array computing and analytics over Spark DataFrames."""
