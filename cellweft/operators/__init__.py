"""Operators of the engine: each takes and returns DataFrames."""
