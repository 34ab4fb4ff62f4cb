"""Operators over the relational model; each takes and returns DataFrames."""
