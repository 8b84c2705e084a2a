"""Batch plans and the query catalogue."""
