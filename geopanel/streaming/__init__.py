"""Structured Streaming: panels from event streams and an online filter."""
