"""Batch operators on DataFrames and catalogue tables."""
