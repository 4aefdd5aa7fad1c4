"""Column expressions: clocks, numbers, texts and bands."""
