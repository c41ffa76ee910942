"""Operators over interval, annotation, read, track and sequence tables."""
