"""Operators of a training-data pipeline on `documents`, `pages` and `embeddings`. Nothing else in the library imports this."""
