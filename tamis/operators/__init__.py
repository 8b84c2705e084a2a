"""Relational operators of the extraction engine."""
