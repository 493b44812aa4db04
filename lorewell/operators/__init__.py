"""Operators over the corpus; each returns a DataFrame."""
