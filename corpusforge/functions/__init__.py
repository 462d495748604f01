"""Column expressions: text, numbers and rule chains."""
