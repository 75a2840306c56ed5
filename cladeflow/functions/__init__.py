"""Column functions and the small parameter types that compile to columns."""
