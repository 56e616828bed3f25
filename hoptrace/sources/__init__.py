"""Readers: each gives a DataFrame with a fixed schema, from files or from lines that are already a DataFrame."""
