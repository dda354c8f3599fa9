"""Relational operators: DataFrames in, a DataFrame out."""
