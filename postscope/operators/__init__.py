"""Operators: each takes and returns lazy DataFrames keyed by ``post_id``."""
