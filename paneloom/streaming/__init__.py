"""Structured Streaming entry to the dated history."""
