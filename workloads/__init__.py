"""Queries over the test tables, and the same in SQL."""
