"""Operators on keys, vectors, names, scores and texts for building training data."""
