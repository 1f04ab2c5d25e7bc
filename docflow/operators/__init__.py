"""Operators of docflow."""
