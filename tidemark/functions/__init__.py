"""Column-level helpers: rounding, dates, labels, text and probability."""
