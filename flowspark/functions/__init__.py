"""Column expressions: labels, numbers, text and time."""
