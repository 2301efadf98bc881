"""Operators on arrays: making, indexing, changing, comparing, reducing, multiplying."""
