"""Relational operators: DataFrames and thresholds in, a DataFrame out. All accept a ``sample`` column where noted."""
