"""Column functions: text, syntax and tokens."""
