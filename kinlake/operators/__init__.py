"""Relational, vector and decision operators."""
