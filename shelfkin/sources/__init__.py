"""Landed responses, dated snapshots, run records."""
