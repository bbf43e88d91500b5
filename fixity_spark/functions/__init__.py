"""Column expressions; all are built-in functions, none runs Python per row."""
