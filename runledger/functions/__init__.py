"""Column expressions and scans of text."""
