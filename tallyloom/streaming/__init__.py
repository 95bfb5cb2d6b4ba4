"""Structured Streaming forms of the resumable and windowed operators."""
