"""Streaming of docflow."""
