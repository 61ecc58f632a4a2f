"""Whole indexes, services and the registered queries."""
