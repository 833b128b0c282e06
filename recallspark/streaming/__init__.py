"""Incremental pickup of new transcript files."""
