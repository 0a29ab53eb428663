"""Operators for training corpora: sharding, near-duplicates, tokenising, extraction, filters and packing."""
