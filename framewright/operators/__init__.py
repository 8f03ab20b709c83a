"""Operators: DataFrames in, DataFrames out. They don't read, write or collect unless they say so."""
