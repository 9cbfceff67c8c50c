"""Urban mobility and land-use analytics on Spark DataFrames."""
