"""Operators for text corpora and embeddings; nothing else in the library imports this."""
