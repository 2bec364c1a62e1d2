"""Sources that are no tables."""
