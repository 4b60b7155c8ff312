"""Domain views, named queries and their SQL checks."""
