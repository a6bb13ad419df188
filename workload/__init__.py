"""Queries over the given tables, their SQL equivalents and shared derivations."""
