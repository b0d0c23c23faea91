"""Composite plans and the named queries."""
