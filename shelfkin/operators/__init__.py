"""Operators on DataFrames: cleaning, features, similarity, matching, recommendation."""
