"""Operators: registry checks, derived tables, analyses and report datasets."""
