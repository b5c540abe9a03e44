"""Market and news analytics on Spark: every operator takes and returns DataFrames."""
