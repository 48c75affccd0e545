"""Functions of the extraction engine."""
