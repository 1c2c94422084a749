"""Readers of files and settings."""
