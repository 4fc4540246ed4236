"""Operators: each takes long tables keyed by (code, ts) and returns a DataFrame."""
