"""Column expressions: rounding, ratios, labels, text patterns."""
