"""Leakage-safe form features over event data, on Spark DataFrames."""
