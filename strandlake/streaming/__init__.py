"""Streaming forms of additive aggregates."""
