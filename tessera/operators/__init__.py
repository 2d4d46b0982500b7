"""Operators that act on the catalog or need more than one query."""
