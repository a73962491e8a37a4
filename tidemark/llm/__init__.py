"""Operators for building training data from text, pages, recordings and conversations."""
