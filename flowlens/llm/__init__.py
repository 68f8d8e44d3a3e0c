"""Operators that prepare training data: deduplication, sharding, scoring, tokens and packing."""
