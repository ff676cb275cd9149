"""Population-based search and the data work around it, on Spark DataFrames."""
