"""Relational operators: each module holds pure functions from DataFrames to a DataFrame."""
