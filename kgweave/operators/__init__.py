"""Relational and iterative operators; each takes and returns DataFrames."""
