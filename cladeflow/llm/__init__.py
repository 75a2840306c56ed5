"""Operators for training data: percentiles, distinct counts, tokens, containers and subjects."""
