"""Metrics and vector transforms."""
