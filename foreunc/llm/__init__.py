"""Operators of a training-data pipeline: filters, near-duplicates, search, tokens, scoring."""
