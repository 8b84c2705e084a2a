"""Streaming daemon."""
