"""Operators for building training data: dedup, formatting, filtering, tokens, sharding, packing."""
