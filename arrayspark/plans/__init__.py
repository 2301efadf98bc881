"""Choices made before a DataFrame is built: chunk shapes, and how operands are brought together."""
