"""Column expressions: dates, codes, text, records."""
