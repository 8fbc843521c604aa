"""Spark jobs for datasets of generated designs: DataFrames in, DataFrames out."""
