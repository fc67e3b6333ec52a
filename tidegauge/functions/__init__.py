"""Column expressions: attributes, text, hashing, arrays."""
