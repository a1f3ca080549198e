"""Operators on solutions, property paths, harvesting, indexing and source selection."""
