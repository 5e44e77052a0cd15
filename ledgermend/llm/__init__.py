"""Operators of a training-data pipeline: deduplication, filtering, mixing, archives and search."""
