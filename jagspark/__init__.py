"""jagspark: ragged-array analytics on plain PySpark DataFrames."""
