"""Session-aware market-bar analytics on Spark DataFrames."""
