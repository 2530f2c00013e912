"""Readers of recordings."""
