"""The table functions, for DataFrames and for SQL."""
