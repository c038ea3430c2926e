"""Column expressions and semantic-layer measures."""
