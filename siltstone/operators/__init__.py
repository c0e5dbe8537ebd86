"""Operators over the ratings tables; each takes and returns DataFrames."""
