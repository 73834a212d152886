"""Observability analytics on Spark: measures, streams, traces, properties and rankings."""
