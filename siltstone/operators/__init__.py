"""Operators of the extraction engine."""
