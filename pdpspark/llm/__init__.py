"""Operators of a training-data pipeline: dedup, search, extraction, scoring, packing, filters, archives, language identification."""
