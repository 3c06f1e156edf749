"""Operators for training-data corpora: deduplication, filters, tokenizers, mixing and search."""
