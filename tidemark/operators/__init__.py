"""Operators over collections of series."""
