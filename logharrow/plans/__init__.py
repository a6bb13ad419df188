"""Composite reports and maintenance jobs."""
