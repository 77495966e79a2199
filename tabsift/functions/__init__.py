"""Column functions: null handling, text, and statistics."""
