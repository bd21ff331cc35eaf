"""Column -> Column helpers, all built from Spark's own functions."""
