"""Column expressions and scores."""
