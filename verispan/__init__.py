"""Permission-aware evidence retrieval and analytics on Spark DataFrames."""
