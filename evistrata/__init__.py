"""Evidence integration and corpus processing on Spark DataFrames."""
