"""Streaming of the extraction engine."""
