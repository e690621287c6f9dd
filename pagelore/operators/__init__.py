"""Operators: each takes and returns DataFrames keyed by document and page, with explicit ordinals."""
