"""Structured Streaming twins of the operators whose state outlives a batch."""
