"""Geographic features and rasters as DataFrames."""
