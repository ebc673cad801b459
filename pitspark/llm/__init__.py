"""Operators of a training-data pipeline: deduplication, filters, models, search and output."""
