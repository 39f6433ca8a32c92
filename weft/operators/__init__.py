"""Operators on DataFrames: paths, facts, vectors, resolution, hierarchies, grading and evaluation."""
