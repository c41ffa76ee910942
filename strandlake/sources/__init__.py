"""Readers of genomic text formats."""
