"""Structured Streaming forms of the continuous rankings."""
