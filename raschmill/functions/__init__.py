"""Column expressions of the response model."""
