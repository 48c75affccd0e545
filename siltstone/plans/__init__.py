"""Plans of the extraction engine."""
