"""Relational operators of the analysis; each takes and returns lazy DataFrames."""
