"""Functions on binary keys and blocks."""
