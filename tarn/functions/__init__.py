"""Column expressions: statistics and text."""
