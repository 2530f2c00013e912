"""Structured Streaming forms of the stateless and windowed operators."""
