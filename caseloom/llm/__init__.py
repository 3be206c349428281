"""Operators for building training data; nothing else in the package imports them."""
