"""Operators on texts and matches for preparing training data."""
