"""Column expressions: analyzers, aggregates, time."""
