"""Operators of a training-data pipeline: tokenising, near duplicates, search, quality, PII, toxicity, licences, packing."""
