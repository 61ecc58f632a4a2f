"""Operators on vector tables; each takes and returns DataFrames."""
