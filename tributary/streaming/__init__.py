"""Structured Streaming forms of the two incremental patterns."""
