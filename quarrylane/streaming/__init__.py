"""Structured Streaming versions of the append-log operators."""
