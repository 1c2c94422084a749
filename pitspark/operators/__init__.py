"""Relational operators on observation tables."""
