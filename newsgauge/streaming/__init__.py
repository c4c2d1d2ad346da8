"""Structured Streaming forms of ingest and of the windowed tables."""
