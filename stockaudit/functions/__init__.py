"""Column expressions: labels, parsing and statistics."""
