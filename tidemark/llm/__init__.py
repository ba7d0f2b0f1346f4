"""Operators on text corpora and embeddings for preparing training data."""
