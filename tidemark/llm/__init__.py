"""Corpus operators for training data: deduplication, mixing, scans, language, extraction, scoring, sharding."""
