"""Table operators: DataFrames in, DataFrames out, for all companies at once."""
