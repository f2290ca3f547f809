"""Operators for large text corpora: filters, deduplication, mixing, tokens, extraction."""
