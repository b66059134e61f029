"""Document preparation for retrieval and training, as lazy Spark DataFrames."""
