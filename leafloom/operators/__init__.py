"""Operators as functions from DataFrames to DataFrames, and as Column expressions."""
