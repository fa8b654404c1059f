"""Analytics for large text corpora on Spark DataFrames."""
