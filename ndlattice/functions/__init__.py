"""Column expressions: one value out for one row in."""
