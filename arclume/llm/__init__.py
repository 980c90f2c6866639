"""Operators for training data: frequent items, overlaps, distinct counts, packing, leaks and sentences."""
