"""Column expressions and small plan helpers."""
