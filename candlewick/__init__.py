"""Market data and corpus jobs for Spark: every operator takes and returns DataFrames."""
