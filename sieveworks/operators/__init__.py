"""DataFrame operators: each takes DataFrames and gives DataFrames, and none collects rows."""
