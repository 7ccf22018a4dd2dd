"""Whole-table operators: DataFrames in, DataFrames out."""
