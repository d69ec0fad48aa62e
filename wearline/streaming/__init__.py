"""Structured Streaming queries built from the same operators as the batch plans."""
