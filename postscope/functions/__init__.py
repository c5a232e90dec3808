"""Column expressions: each takes and returns columns, no data is touched."""
