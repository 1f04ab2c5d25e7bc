"""Sources of docflow."""
