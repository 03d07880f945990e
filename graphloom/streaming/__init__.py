"""Incremental rebuilds from a feed of file changes, and windows over event streams."""
