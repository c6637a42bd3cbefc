"""Structured Streaming jobs over arriving texts."""
