"""Ordered and streaming operators."""
