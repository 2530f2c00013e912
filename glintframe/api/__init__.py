"""Fluent wrappers: streams, events, epochs, recordings, data sets."""
