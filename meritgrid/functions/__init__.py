"""Column expressions: text, dates, nested data."""
