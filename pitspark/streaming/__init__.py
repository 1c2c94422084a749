"""Incremental reads."""
