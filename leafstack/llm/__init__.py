"""Operators that prepare training data: each is a function from DataFrames to DataFrames."""
