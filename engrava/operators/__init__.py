"""Operators: each takes DataFrames and returns a DataFrame."""
