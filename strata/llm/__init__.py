"""Operators of a training-data pipeline: extraction, deduplication, quality, mixing, tokens, search."""
