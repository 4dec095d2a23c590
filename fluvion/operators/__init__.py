"""Operators on panels, pairs and graphs: DataFrames in, DataFrames out."""
