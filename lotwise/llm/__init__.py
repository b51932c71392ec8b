"""Operators of a training-data pipeline: archives, deduplication, token counts, shards, search, mixing, quality.

Nothing else in the library imports this package; it may use the library's general helpers."""
