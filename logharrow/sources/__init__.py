"""Readers, writers and the small dimension tables."""
