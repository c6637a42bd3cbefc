"""Column functions: text and vectors in, columns out; no Python runs per row."""
