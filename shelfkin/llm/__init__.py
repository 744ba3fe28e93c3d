"""Operators for preparing training data: dedup, tokenizing, filtering, formatting, search."""
