"""Column functions: sequences, mismatch strings and modifications."""
