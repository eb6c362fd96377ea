"""Column expressions and Arrow functions on text and values."""
