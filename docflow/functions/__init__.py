"""Functions of docflow."""
