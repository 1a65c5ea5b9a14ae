"""Structured Streaming forms of the running statistics."""
