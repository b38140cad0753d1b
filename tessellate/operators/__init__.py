"""Operators over whole DataFrames: changes, relations, recursion, checks."""
