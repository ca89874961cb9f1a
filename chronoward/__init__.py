"""Time-series analytics for irregular event tables, built on Spark DataFrames."""
