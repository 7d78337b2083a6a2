"""Text-knowledge analytics on Spark DataFrames."""
