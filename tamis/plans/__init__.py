"""Queries over the given tables, each with its comparison SQL, and the composed experiments."""
