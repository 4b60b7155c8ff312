"""Readers, registry feeds and sinks."""
