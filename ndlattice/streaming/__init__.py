"""The same expressions and window aggregates on streams."""
