"""Operators of a training-data pipeline: language, duplicates, mixing, packing, filters, tokens, neighbours."""
