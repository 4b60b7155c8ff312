"""Weights, keywords, bands and mappings."""
