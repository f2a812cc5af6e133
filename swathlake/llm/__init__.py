"""Operators on text, pages and vectors for preparing training data."""
