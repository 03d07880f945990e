"""Operators take and give DataFrames in the schemas of graphloom.model; none reads a path."""
