"""Column functions and the per-file row helper."""
