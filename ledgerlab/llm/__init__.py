"""Operators for large text and embedding corpora; nothing else in the library imports this package."""
