"""Record-comparison analytics on Spark DataFrames."""
