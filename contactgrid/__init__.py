"""Site-contact analytics on Spark: DataFrames in, DataFrames out."""
